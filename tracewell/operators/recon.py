"""Reconciliation of open positions with versioned submissions."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_suffix
from . import scan


#: Reasons of a break by what they say, result columns by what they hold, and the id of a submission.
REASONS = {
    "equal": "value_mismatch_reghub_error", "timing": "false_break_timing_issue", "rejected": "pending_nack_resolution", "exempt": "non_reportable_review",
    "missing": "missing_from_source", "behind": "olympus_data_issue", "unknown": "cannot_be_determined",
}
NAMES = {
    "version": "olympus_version", "linked_version": "dtcc_reflected_version", "latest_version": "reghub_latest_version", "latest_status": "reghub_latest_status",
    "reason": "field_control_break_reason",
}
SUBMISSION_ID = "reghub_id"


def classify(
    positions: DataFrame, submissions: DataFrame, recon_id: object | None = None, reasons: Mapping[str, str] = REASONS, names: Mapping[str, str] = NAMES,
    submission_id: str = SUBMISSION_ID, order: bool = False,
) -> DataFrame:
    """Reason of each open position's break.

    ``reasons`` names the outcomes, ``names`` renames result columns, ``submission_id``
    is the column of a submission's own id; ``order`` sorts the rows by uitid.

    Two left equi-joins: to the submission that the position's message names,
    and to the latest one of its uitid (reg_ranking 1).  Nothing is deduplicated,
    so keys that repeat fan out.  Whatever a missing side leaves null cannot be
    determined.
    """
    open_ = positions.where(F.upper("break_status") == "OPEN")
    if recon_id is not None:
        open_ = open_.where(F.col("recon_id") == recon_id)
    g = open_.select("uitid", "version", "break_type", strip_suffix(F.col("tsr_msg_id")).alias("linked_id"))
    lr = submissions.select(F.col(submission_id).alias("linked_id"), F.col("keys_uitid").alias("uitid"), F.col("version").alias("linked_version"))
    latest = submissions.where("reg_ranking = 1").select(
        F.col("keys_uitid").alias("uitid"), F.col(submission_id).alias("latest_id"), F.col("version").alias("latest_version"), F.col("state_status").alias("latest_status")
    )
    ahead, behind = F.col("version") > F.col("linked_version"), F.col("version") < F.col("linked_version")
    same, other = F.col("linked_id") == F.col("latest_id"), F.col("linked_id") != F.col("latest_id")
    status = F.col("latest_status")
    reason = (
        F.when((F.col("version") == F.col("linked_version")) & same, reasons["equal"])
        .when(ahead & other & (status == "ACK"), reasons["timing"])
        .when(ahead & other & (status == "NACK"), reasons["rejected"])
        .when(ahead & other & (status == "NON_REPORTABLE"), reasons["exempt"])
        .when(ahead & same, reasons["missing"])
        .when(behind, reasons["behind"])
        .otherwise(reasons["unknown"])
    )
    found = g.join(lr, ["linked_id", "uitid"], "left").join(latest, "uitid", "left").select(
        "uitid", "version", "linked_version", "latest_version", "latest_status", "break_type", reason.alias("reason")
    )
    found = found.orderBy("uitid") if order else found
    return found.withColumnsRenamed(dict(names))


def latest(df: DataFrame, keys: Sequence[str], order_by: Sequence) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).where("_n = 1").drop("_n")


def load_rank(df: DataFrame, keys: Sequence[str], order_by: Sequence, name: str = "load_rank") -> DataFrame:
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order_by)))


def running_sum(df: DataFrame, keys: Sequence[str], order_by: Sequence, value, name: str = "running") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order_by)))


def rank_of(df: DataFrame, keys: Sequence[str], order: str, name: str = "rank", chunk: int = scan.CHUNK) -> DataFrame:
    """``df`` with the rank of each row within its keys by rising ``order``, a column of whole numbers; equal ones share the first rank.

    Rows of one value are counted before anything is shuffled, and values are
    accumulated by chunks of ``chunk`` in width, so that a key of any number of
    rows is spread over all tasks.  Rows without an order have no rank; null keys
    are a key of their own.
    """
    counts = df.where(F.col(order).isNotNull()).groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_n"))
    before = scan.prefix_scan(counts, keys, order, {"_before": ("sum", F.col("_n"))}, chunk)
    own = [*keys, order]
    found = before.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(own)], (F.col("_before") + 1).alias(name))
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(own)])
    return df.join(found, same, "left").drop(*[f"_k{i}" for i in range(len(own))])


def total_of(df: DataFrame, keys: Sequence[str], value: Column, name: str = "total") -> DataFrame:
    """``df`` with an aggregate of each row's keys, formed on the map side and joined to the rows."""
    found = df.groupBy(*keys).agg(value.alias(name)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], name)
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    return df.join(found, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def extract(df: DataFrame, parameters: Mapping[str, Sequence]) -> DataFrame:
    """Feeder: the rows whose columns hold one of the values asked for."""
    for column, values in parameters.items():
        df = df.where(F.col(column).isin(list(values)))
    return df
