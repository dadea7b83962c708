"""Running values over very long ordered groups, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a chunk in steps of the order column.
CHUNK = 65_536


def prefix_scan(df: DataFrame, by: Sequence[str], order: str, folds: Mapping[str, tuple[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """``df`` with a column per fold: what the rows before it, in the order of its group, come to.

    ``folds``: name -> (kind, value), where kind is sum (0 at first), max or last
    (not null).  The order column holds whole numbers and is cut into chunks of
    equal width.  Chunks are summed up on the map side, the sums, one row per
    chunk, are accumulated, and each chunk is scanned by itself from what comes
    before it; so one group of any length is spread over all tasks.  Rows whose
    order is null are left out; rows of one order value come in any order.
    """
    chunk_no = F.floor(F.col(order) / chunk)
    # One struct as key, nulls in it being equal, so that the rows stay where the windows put them when they are joined.
    chunked = df.where(F.col(order).isNotNull()).withColumn("_chunk", F.struct(*by, chunk_no.alias("no")))
    inner = list(folds)
    total = {
        "sum": lambda v: F.sum(v), "max": lambda v: F.max(v), "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.col(order))),
    }
    running = {"sum": lambda v, w: F.coalesce(F.sum(v).over(w), F.lit(0)), "max": lambda v, w: F.max(v).over(w), "last": lambda v, w: F.last(v, ignorenulls=True).over(w)}
    both = {"sum": lambda a, b: a + b, "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
    chunks = chunked.groupBy("_chunk").agg(*[total[kind](v).alias(n) for n, (kind, v) in folds.items()])
    so_far = Window.partitionBy(*[F.col("_chunk")[c] for c in by]).orderBy(F.col("_chunk")["no"]).rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(F.col("_chunk").alias("_key"), *[running[folds[n][0]](F.col(n), so_far).alias(f"_b_{n}") for n in inner])
    within = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.select("*", *[running[kind](v, within).alias(f"_l_{n}") for n, (kind, v) in folds.items()])
    return local.join(before, F.col("_chunk") == F.col("_key")).select(*df.columns, *[both[folds[n][0]](F.col(f"_b_{n}"), F.col(f"_l_{n}")).alias(n) for n in inner])
