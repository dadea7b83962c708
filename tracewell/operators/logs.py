"""Error blocks of logs and their root causes.

Whether a line lies in a block follows from the last start and the last blank
line before it, and a block's number from the starts before it.  These are
running values, taken by chunks (``prefix_scan``), so one huge log is spread
over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NO_CAUSE
from .scan import CHUNK, prefix_scan

#: What begins a block.
STARTS = "Exception|ERROR|Caused by"


def error_blocks(lines: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line", chunk: int = CHUNK) -> DataFrame:
    """(file, block_id, line_no, line): from a line with Exception, ERROR or Caused by to the next such or a blank line.

    Files are independent; a block that is open at the end of its file counts.
    Blocks are numbered from 1 in the order of their files.  Line numbers may have
    gaps; lines without a number are left out, and null lines are in no block's way.
    """
    named = lines.select(F.col(file).alias("_f"), F.col(line_no).alias("_n"), F.col(line).alias("_t"), F.coalesce(F.col(line).rlike(STARTS), F.lit(False)).alias("_s"))
    folds = {
        "_starts": ("sum", F.col("_s").cast("long")), "_opened": ("max", F.when(F.col("_s"), F.col("_n"))), "_closed": ("max", F.when(F.trim("_t") == "", F.col("_n"))),
    }
    scanned = prefix_scan(named, ["_f"], "_n", folds, chunk)
    inside = F.col("_s") | F.coalesce(F.col("_opened") > F.col("_closed"), F.col("_opened").isNotNull())
    return scanned.where(inside).select(F.col("_f").alias(file), (F.col("_starts") + F.col("_s").cast("long")).alias("block_id"), F.col("_n").alias(line_no), F.col("_t").alias(line))


def root_causes(blocks: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line", most: int = 5000, chunk: int = CHUNK) -> DataFrame:
    """(file, block_id, root_cause, trace): the last cause named in a block; the trace's first ``most`` characters.

    A cause may stand on the line after its mark.  Only the lines that reach into
    the trace are gathered, and the cause is the last one by line, so a block of
    any length is no burden.
    """
    marked = F.col("_t").rlike(r"Caused by:\s+\S")
    waiting = ~marked & F.col("_t").rlike(r"Caused by:\s*$")
    named = blocks.select(F.col(file).alias("_f"), F.col("block_id").alias("_b"), F.col(line_no).alias("_n"), F.coalesce(line, F.lit("")).alias("_t"))
    scanned = prefix_scan(named, ["_f", "_b"], "_n", {"_at": ("sum", F.length("_t") + 1), "_open": ("last", F.when(F.col("_t").rlike(r"\S"), waiting))}, chunk)
    cause = (
        F.when(marked, F.regexp_extract("_t", r"Caused by:\s+([^\n]*)", 1)).when(F.col("_t").rlike(r"Caused by:\s+$"), "")
        .when(F.col("_open") & ~waiting, F.regexp_replace("_t", r"^\s+", ""))
    )
    # A line that begins right after the last character still gives its line break.
    begun = F.collect_list(F.when(F.col("_at") <= most, F.struct("_n", "_t")))
    whole = scanned.withColumn("_c", cause).groupBy("_f", "_b").agg(F.max_by("_c", F.when(F.col("_c").isNotNull(), F.col("_n"))).alias("_c"), begun.alias("_x"))
    trace = F.array_join(F.transform(F.array_sort("_x"), lambda s: s["_t"]), "\n")
    return whole.select(F.col("_f").alias(file), F.col("_b").alias("block_id"), F.coalesce("_c", F.lit(NO_CAUSE)).alias("root_cause"), F.substring(trace, 1, most).alias("trace"))


def block_count(blocks: DataFrame, file: str = "file") -> DataFrame:
    """(file, n_blocks) of files with blocks; blocks are numbered without gaps."""
    return blocks.groupBy(file).agg(F.max("block_id").alias("n_blocks"))
