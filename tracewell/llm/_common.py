"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap row built by ``bitmap_construct_agg`` (fixed by Spark).
BITMAP_ROW_BITS = 32768
#: Spark's setting by which a query's shuffle files go as soon as it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint and cut its lineage.

    What was shuffled for ``df`` is freed as soon as it is written.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))
    with shuffles_freed(spark):
        return df.select("*").checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and end in this block leave no shuffle files behind; the setting counts when a DataFrame is made."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor share: the cluster's ``spark.checkpoint.dir``.

    A temporary one is made only on a local master that names none, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="shared-")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that was written for one step only and has been read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bitmap_of(hashes: DataFrame, col: str, bits: int) -> DataFrame:
    """Fixed-size bitmap of 64-bit hashes: rows (bm_bucket, bm), ``bits``/8 bytes in all.

    The size never depends on the number of hashes, so it may be broadcast.
    """
    pos = F.pmod(F.col(col), F.lit(bits))
    return (
        hashes.select(
            F.floor(pos / BITMAP_ROW_BITS).cast("int").alias("bm_bucket"),
            F.pmod(pos, F.lit(BITMAP_ROW_BITS)).alias("bm_pos"),
        )
        .groupBy("bm_bucket")
        .agg(F.bitmap_construct_agg("bm_pos").alias("bm"))
    )


def flag_in_bitmap(df: DataFrame, col: str, bitmap: DataFrame, bits: int, flag: str, how: str = "left") -> DataFrame:
    """Add ``flag``: whether the hash in ``col`` may be in ``bitmap`` (no false negatives)."""
    pos = F.pmod(F.col(col), F.lit(bits))
    inner = F.pmod(pos, F.lit(BITMAP_ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("bm", F.lit(1) + F.floor(inner / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(inner, F.lit(8))) == 1, F.lit(False))
    return (
        df.withColumn("bm_bucket", F.floor(pos / BITMAP_ROW_BITS).cast("int"))
        .join(F.broadcast(bitmap), "bm_bucket", how)
        .withColumn(flag, hit)
        .drop("bm_bucket", "bm")
    )


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 1 << 23) -> DataFrame:
    """The rows of ``docs`` whose (id, text_hash) is not in ``dropped``; only likely matches are shuffled."""
    columns = docs.columns
    names = dropped.select(F.col(id_col).alias("_did"), F.col("text_hash").alias("_dh")).distinct()
    keyed = docs.withColumn("_th", F.xxhash64(text_or_empty(text_col))).withColumn("_key", F.xxhash64(id_col, "_th"))
    marked = flag_in_bitmap(keyed, "_key", bitmap_of(names.select(F.xxhash64("_did", "_dh").alias("_key")), "_key", bits), bits, "_in")
    same = F.col(id_col).eqNullSafe(F.col("_did")) & (F.col("_th") == F.col("_dh"))
    return marked.where("NOT _in").unionByName(marked.where("_in").join(names, same, "left_anti")).select(*columns)
