"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

One pass over the texts takes lengths and prefix hashes as thin rows; prefixes
are only counted among rows whose length occurs more than once, and a second
pass hashes whole texts only where the prefix does, too.  What one level tells
the next is a bitmap of fixed size (``bitmap_bits``), so no level shuffles texts
and nothing that grows with the data is broadcast.  A bit set by chance only
sends a unique text on to the full hash; it can never hide a copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bitmap_of, cut, flag_in_bitmap

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null becomes empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _repeated(df: DataFrame, key: str, bits: int) -> DataFrame:
    """Bitmap of the keys that occur more than once (pre-aggregated on the map side)."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bitmap_of(twice, key, bits)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    prefix_chars: int = 64,
    bitmap_bits: int = 1 << 24,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and the ``carry`` columns.

    Texts are equal when identical after white-space normalisation; null counts
    as empty.  The smallest id of a group stays; of rows that repeat that id all
    but one are still rows of the group and count in group_size, and all of them
    are marked kept, as they are the same row.  A null id sorts after all
    others.  Other columns of ``docs`` are ignored, whatever their names.
    """
    carried = [f"_c{i}" for i in range(len(carry))]
    texts = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(a) for c, a in zip(carry, carried, strict=True)], normalised(F.col(text_col)).alias("_norm"))
    level = texts.withColumn("_k1", F.xxhash64(F.length("_norm"))).withColumn("_k2", F.xxhash64(F.length("_norm"), F.substring("_norm", 1, prefix_chars)))

    thin = cut(level.select("_k1", "_k2"))
    by_length = cut(_repeated(thin, "_k1", bitmap_bits))
    by_prefix = cut(_repeated(flag_in_bitmap(thin, "_k1", by_length, bitmap_bits, "_s1").where("_s1"), "_k2", bitmap_bits))
    level = flag_in_bitmap(level, "_k1", by_length, bitmap_bits, "_s1")
    level = flag_in_bitmap(level, "_k2", by_prefix, bitmap_bits, "_s2")
    rows = cut(level.select("_id", *carried, F.when(F.col("_s1") & F.col("_s2"), F.sha2(F.col("_norm"), 256)).alias("_full")))

    # Written first, so that the join below may split a group that holds a large part of the rows.
    groups = cut(rows.where("_full IS NOT NULL").groupBy("_full").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    alone = rows.where("_full IS NULL").drop("_full")
    met = rows.where("_full IS NOT NULL").join(groups, "_full", "left").drop("_full")
    out = met.unionByName(alone, allowMissingColumns=True)
    grouped = F.col("_n").isNotNull()
    keep = F.when(grouped, F.col("_keep")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )
