"""Streaming forms: checks per micro-batch, windowed violation counts, branch diffs as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dq import run_checks
from ..operators.logs import error_blocks, root_causes
from ..operators.metadata import diff


def check_stream(stream: DataFrame, rules: Mapping[str, Any], sink: Callable[[str, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run all checks on each micro-batch; ``sink`` gets (check, rows, batch id) and should be idempotent by batch id."""

    def batch(df: DataFrame, batch_id: int) -> None:
        for name, rows in run_checks(df, rules).items():
            sink(name, rows, batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def violation_counts(stream: DataFrame, violation, ts: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, n, violations) per window, late rows dropped beyond the watermark."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count(F.lit(1)).alias("n"), F.count_if(violation).alias("violations"))
        .select(F.col("window.start").alias("start"), "n", "violations")
    )


def log_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Root causes of whole log files as they arrive: (file, line_no, line) batches."""
    return stream.writeStream.foreachBatch(lambda df, k: sink(root_causes(error_blocks(df)), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def diff_stream(stream: DataFrame, base: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch of (name, value) against a fixed snapshot."""
    return stream.writeStream.foreachBatch(lambda df, k: sink(diff(df, base), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
