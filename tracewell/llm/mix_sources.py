"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / quality with u a hash of its id and text, so the
smallest keys are a sample without replacement in proportion to quality.
Whole epochs of a source come first; the rest of its budget is the prefix of
the key order.  The prefix sum is never taken over a source's rows in one task:
keys are cut into buckets, bucket sums are accumulated, and only the one bucket
per source in which the budget ends is ordered row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of letters and spaces in the text, between 0.1 and 1; null and empty count as 0.1."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L} \n]+", ""))
    return F.greatest(F.lit(0.1), F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.1)).cast("double"))


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) from the md5 of the columns' texts: 48 bits, the same on every run."""
    joined = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols])
    return (F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _spread(key: Column) -> Column:
    """A number from 0 to 1 that grows with the key and is spread evenly whatever the qualities are, to a small factor.

    The keys of quality q have the distribution 1 - exp(-q * key); this is its
    mean over qualities between 0.1 and 1.
    """
    qualities = (0.1, 0.2, 0.4, 0.6, 0.8, 1.0)
    return sum((1 - F.exp(-q * key) for q in qualities), F.lit(0.0)) / float(len(qualities))


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Targets of (source, source_size) rows: shares by weight, stopped at ``most`` times the size.

    The excess over a stopped source is reshared by weight until none is above:
    with the sources in order of cap / weight, those stopped are a prefix, and
    the level of the others is what is left over the weights that are left.
    """
    k = len(weights)
    by_code_point = Window.orderBy(F.col("_source").isNull(), F.encode(F.col("_source"), "utf-8"))
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_code_point) - 1, F.lit(k)) + 1).cast("int")))
    every = Window.partitionBy()
    cap = F.col("_size") * float(most)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), F.encode(F.col("_source"), "utf-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("_cap", cap)
        .withColumn("_total", F.sum("_size").over(every).cast("double"))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn("_final", F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_w")))
    return levels.select("_source", "_size", target.alias("_target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    seed: int = 0,
    buckets: int = 4096,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, epochs, text_hash (xxhash64).

    Sources take ``weights`` in turn in code-point order, null last.  Null text
    has size 0.  ``taken`` is size times the copies that the mix holds.  The
    document in which a budget ends is taken when half of it fits, so a source
    misses its target by at most half a document.  Repeated rows and equal keys
    are told apart by id only where they differ; a run of rows that share both
    key and id is ordered arbitrarily among themselves, with equal effect.
    Tables without rows give no rows.  Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    thin = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"),
            F.col(source_col).cast("string").alias("_source"),
            word_count(text).alias("_n"),
            (-F.ln(uniform(F.lit(seed), F.col(id_col), F.md5(F.coalesce(text, F.lit(""))))) / quality_weight(text)).alias("_key"),
        ).withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor(_spread(F.col("_key")) * buckets)).cast("int"))
    )
    sums = cut(thin.groupBy("_source", "_bucket").agg(F.sum("_n").alias("_bn")))
    targets = source_targets(sums.groupBy("_source").agg(F.sum("_bn").alias("_size")), weights, most)

    size, target = F.col("_size"), F.col("_target")
    epochs = F.when(size > 0, F.least(F.lit(int(most)), F.floor(target / size))).otherwise(0).cast("int")
    plan = targets.withColumn("_epochs", epochs).withColumn("_left", F.greatest(F.lit(0.0), target - F.col("_epochs") * size))
    running = Window.partitionBy("_source").orderBy("_bucket")
    edges = (
        sums.withColumn("_before", F.sum("_bn").over(running.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_before", F.coalesce("_before", F.lit(0)))
        .join(plan.select(F.col("_source").alias("_s"), "_size", "_target", "_epochs", "_left"), F.col("_source").eqNullSafe(F.col("_s")))
        .select(
            "_s", F.col("_bucket").alias("_b"), "_before", "_size", "_target", "_epochs", "_left",
            F.when(F.col("_before") + F.col("_bn") <= F.col("_left"), 1).when(F.col("_before") >= F.col("_left"), 0).otherwise(2).alias("_state"),
        )
    )
    placed = thin.join(edges, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    whole = placed.where("_state < 2").withColumn("_in", F.col("_state") == 1)
    in_order = Window.partitionBy("_s", "_b").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("_state = 2").withColumn(
        "_in", F.col("_before") + F.coalesce(F.sum("_n").over(in_order), F.lit(0)) + F.col("_n") / 2 <= F.col("_left")
    )
    return whole.unionByName(edge).select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("size"),
        F.col("_size").cast("long").alias("source_size"),
        F.col("_target").cast("double").alias("target"),
        (F.col("_n") * (F.col("_epochs") + F.col("_in").cast("int"))).cast("long").alias("taken"),
        (F.col("_epochs") + F.col("_in").cast("int")).cast("int").alias("epochs"),
        F.col("_h").alias("text_hash"),
    )
