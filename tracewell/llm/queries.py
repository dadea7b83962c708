"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_path, table
from .bpe import decode_ids, encode_texts
from .collocations import mine_collocations
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup, normalised
from .license_scan import scan_licenses
from .mix_sources import mix_sources
from .ngram_jaccard import jaccard_components
from .ppm import score_documents
from .suffix_dedup import dedup_substrings
from .token_file import read_token_blocks, write_token_blocks
from .toxicity import score_toxicity
from .url_filter import filter_urls
from .whitening import whiten


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write_token_blocks(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_blocks(spark, path)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100).drop("text_hash")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs.select("doc_id", "text", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")), carry=["text_sha256"])


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "text_hash")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op9_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), within_tokens=False)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    sha = lambda c: F.sha2(c, 256)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha("decoded").alias("decoded_sha256")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_token_file, op3_mix_sources, op4_ngram_jaccard, op5_exact_dedup, op6_url_filter, op7_decontaminate, op8_suffix_dedup, op9_ppm_score, op10_license_scan, op11_bpe_codec, op12_collocations, op13_whitening)
}
