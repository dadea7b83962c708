"""Data-quality checks, each a DataFrame; a missing column gives an error row instead."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[name] in ("double", "float") else c.isNull()


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of the columns with missing values, in one pass."""
    sums = df.agg(*[F.sum(is_missing(df, c).cast("long")).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("nulls")) for c in df.columns]))
    return sums.select(pairs.alias("p")).select("p.column", "p.nulls").where("nulls > 0")


def duplicates(df: DataFrame, order_by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Second and further copies of whole rows (or of ``columns``), nulls equal."""
    over = Window.partitionBy(*[F.col(f"`{c}`") for c in columns or df.columns]).orderBy(*(order_by or [F.lit(1)]))
    return df.withColumn("_n", F.row_number().over(over)).where("_n > 1").drop("_n")


def out_of_range(df: DataFrame, column: str = "age", least: float = 0, most: float = 999) -> DataFrame:
    """Rows below ``least`` or above ``most``; missing values are no violation."""
    c = F.col(f"`{column}`")
    return df.where(((c < least) | (c > most)) & ~is_missing(df, column))


def pattern_violations(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text doesn't match from its start; null is the text nan."""
    return df.where(~F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("nan")).rlike(f"^(?:{pattern})"))


def domain_violations(df: DataFrame, column: str, allowed: Sequence[Any]) -> DataFrame:
    """Rows with a value outside the list; null is a violation."""
    c = F.col(f"`{column}`")
    return df.where(~F.coalesce(c.isin(list(allowed)), F.lit(False)))


def run_checks(df: DataFrame, rules: Mapping[str, Any]) -> dict[str, DataFrame]:
    """All checks that the rules ask for, by name; values are lazy.

    Rules: ``columns.<name>`` with min/max, pattern, allowed_values (or allowed)
    and required.  A missing column of a range rule gives an (error) row; of
    pattern and domain rules it is left out.
    """
    out = {"nulls": null_counts(df), "duplicates": duplicates(df)}
    for name, rule in (rules.get("columns") or {}).items():
        there = name in df.columns
        if "min" in rule or "max" in rule:
            missing = df.sparkSession.createDataFrame([(f"Column '{name}' not found",)], "error string")
            out[f"range:{name}"] = out_of_range(df, name, rule.get("min", 0), rule.get("max", 999)) if there else missing
        if rule.get("pattern") and there:
            out[f"pattern:{name}"] = pattern_violations(df, name, rule["pattern"])
        allowed = rule.get("allowed_values", rule.get("allowed"))
        if allowed and there:
            out[f"domain:{name}"] = domain_violations(df, name, allowed)
        if rule.get("required") and there:
            out[f"required:{name}"] = df.where(is_missing(df, name))
    return out
