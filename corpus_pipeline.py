"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix, write token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm._common import bitmap_of, cut, flag_in_bitmap, table, text_or_empty, without
from tracewell.llm.decontaminate import decontaminate
from tracewell.llm.mix_sources import mix_sources
from tracewell.llm.ngram_jaccard import jaccard_components
from tracewell.llm.token_file import new_path, read_token_blocks, write_token_blocks
from tracewell.llm.toxicity import score_toxicity


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, source and the whole row as one column, so that no column of it can clash with a helper's."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select("doc_id", "text", "source", F.struct(*columns).alias("_row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier chain rejects.

    Null and empty texts are judged by the models' constants; repeated rows are
    judged alike; an empty table stays empty.
    """
    return score_toxicity(packed(docs), table(spark, sf_dir, "labels"), keep=["_row"]).where("NOT rejected").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by 5-word shingles at 0.8.

    It is the row with the least id, null last; among those the one with the
    least text hash, then the least hash of the whole row.  Texts without words
    are in no group and stay.
    """
    docs = packed(docs)
    groups = jaccard_components(docs, k=5, num=80, den=100, group_col="_group").where("_group IS NOT NULL")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    least = groups.groupBy("_group").agg(F.min(first).alias("_least"), F.count(F.lit(1)).alias("_m")).where("_m > 1")
    members = cut(groups.join(least, "_group").select("doc_id", "text_hash", (first == F.col("_least")).alias("_first")))
    # Rows that repeat the id and text of the first one.
    again = cut(members.where("_first").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1"))
    left = without(docs, members.where("NOT _first").select("doc_id", "text_hash").unionByName(again.select("doc_id", "text_hash")))
    if again.isEmpty():
        return left.select("_row.*")
    bits = 1 << 23
    keyed = docs.withColumn("_th", F.xxhash64(text_or_empty())).withColumn("_key", F.xxhash64("doc_id", "_th"))
    likely = flag_in_bitmap(keyed, "_key", bitmap_of(again.select(F.xxhash64("doc_id", "text_hash").alias("_key")), "_key", bits), bits, "_in").where("_in")
    same = F.col("doc_id").eqNullSafe(F.col("_did")) & (F.col("_th") == F.col("_dh"))
    repeated = likely.join(again.select(F.col("doc_id").alias("_did"), F.col("text_hash").alias("_dh")), same, "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "_th").orderBy(F.xxhash64("_row")))
    return left.unionByName(repeated.withColumn("_place", place).where("_place = 1").select(*docs.columns)).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages; null and empty texts hold none, repeated rows go together."""
    docs = packed(docs)
    return without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")).select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights.

    Rows that repeat an id and a text get the epochs of the mix between them, no
    more than it takes.  Texts without words have size 0 and follow their source.
    """
    docs = packed(docs)
    epochs = F.col("epochs")
    taken = cut(mix_sources(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).agg(F.min(epochs).alias("_least"), F.max(epochs).alias("_epochs"), F.sum(epochs).alias("_all"), F.count(F.lit(1)).alias("_m")).where("_epochs > 0"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h"))
    joined = docs.withColumn("_th", F.xxhash64(text_or_empty())).join(taken, same)
    copies = joined.where("_least = _epochs")
    if not taken.where("_least < _epochs").isEmpty():
        # A budget ended among equal rows: the first of them get one epoch more.
        place = F.row_number().over(Window.partitionBy("doc_id", "_th").orderBy(F.xxhash64("_row")))
        uneven = joined.where("_least < _epochs").withColumn("_n", place).withColumn("_epochs", (F.col("_least") + (F.col("_n") <= F.col("_all") - F.col("_least") * F.col("_m")).cast("int")).cast("int")).where("_epochs > 0").drop("_n")
        copies = copies.unionByName(uneven)
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_epochs")))).select("_row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the ids of what is left, and return what the files hold of each document."""
    import public_tokenizers

    path = new_path(spark, "corpus-ids")
    write_token_blocks(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_blocks(spark, path)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_ids),
]

#: The classifier chain cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
