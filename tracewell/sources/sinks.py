"""Writers: CSV, one folder per check, an Excel report where openpyxl exists, a JSON envelope."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """With a header; nothing to write is an error.  ``single_file`` is for small results."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    text = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    (text.coalesce(1) if single_file else text).write.mode("overwrite").option("header", "true").csv(path)


def write_report(results: Mapping[str, DataFrame], path: str) -> None:
    """A Parquet folder per check."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name.replace(':', '_')}")


def write_excel(results: Mapping[str, DataFrame], path: str, most_rows: int = 1_000_000) -> None:
    """A sheet per check, on the driver: a sheet holds ``most_rows`` at most, and more is an error."""
    import openpyxl  # noqa: F401
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        for name, df in results.items():
            rows = df.limit(most_rows + 1).toPandas()
            if len(rows) > most_rows:
                raise ValueError(f"{name} does not fit a sheet; use write_report")
            rows.to_excel(book, sheet_name=name.replace(":", "_")[:31], index=False)


def envelope(df: DataFrame, message: str = "ok") -> DataFrame:
    """One row per record with the envelope's fields beside it: a whole corpus is never gathered in one value.

    ``json_envelope`` makes the single document of a small result.
    """
    return df.select(F.lit(True).alias("success"), F.lit(message).alias("message"), F.lit(df.count()).cast("long").alias("total_records"), F.to_json(F.struct(*df.columns)).alias("record"))


def json_envelope(df: DataFrame, message: str = "ok", most_rows: int = 100_000) -> DataFrame:
    """{success, message, total_records, lineage_data} as one JSON text; an error beyond ``most_rows``."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError("too many rows for one document; use envelope")
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    return df.agg(rows.alias("r")).select(F.to_json(F.struct(F.lit(True).alias("success"), F.lit(message).alias("message"), F.size("r").alias("total_records"), F.col("r").alias("lineage_data"))).alias("body"))
