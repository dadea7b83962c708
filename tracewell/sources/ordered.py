"""Sorted tables whose order a reader can check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns that a sorted table has besides its own: the number of a range, and of a row within it.
RANGE, PLACE = "_range", "_place"


def write_ordered(df: DataFrame, path: str, by: Sequence[str], format: str = "parquet") -> None:
    """Write ``df`` sorted by the columns ``by``, ascending, null first, without gathering it.

    Rows are dealt by ranges of the order and sorted within them; each range is
    written with its number and the rows' places in it, so that the order of the
    whole can be read back whatever files are called.
    """
    if {RANGE, PLACE} & set(df.columns):
        raise ValueError(f"{RANGE} and {PLACE} are names of the table's order")
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    # The upper bits of the id are the partition's number, the lower 33 the row's.
    spread.select("*", F.shiftright(at, 33).cast("int").alias(RANGE), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(PLACE)).write.format(format).save(path)


def read_ordered(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """The rows with ``order_no``, their place in the whole order, from 0."""
    table = spark.read.format(format).load(path)
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n")).select(RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return table.join(starts, RANGE).withColumn("order_no", F.col("_before") + F.col(PLACE)).drop(RANGE, PLACE, "_before")


def misplaced(ordered: DataFrame, by: Sequence[str], chunk: int = 1 << 16) -> DataFrame:
    """Rows of ``read_ordered`` that come before the row in front of them; none where the table is sorted."""
    from ..operators.scan import prefix_scan

    key = F.struct(*by)
    scanned = prefix_scan(ordered.withColumn("_all", F.lit(0)), ["_all"], "order_no", {"_front": ("last", key)}, chunk)
    return scanned.where(F.col("_front") > key).drop("_all", "_front")
