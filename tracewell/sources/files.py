"""Readers: CSV, YAML rules, JSON folders, SQL files and dictionaries, logs, inline rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; types inferred unless a schema is given."""
    reader = spark.read.option("header", "true")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


def rules_from_yaml(text: str) -> dict[str, Any]:
    import yaml

    return yaml.safe_load(text) or {}


def read_rules(spark: SparkSession, path: str) -> dict[str, Any]:
    """YAML rules from any store that Spark reads; a rule file is one small text."""
    return rules_from_yaml(spark.read.text(path, wholetext=True).first()[0])


def read_json_texts(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """(file, payload, error) of each file below ``path`` with such a name; a bad file has an error and no payload."""
    texts = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    good = F.try_parse_json("value").isNotNull()
    return texts.select("file", F.when(good, F.col("value")).alias("payload"), F.when(~good, "invalid JSON").alias("error"))


def read_uploaded_json(spark: SparkSession, path: str) -> DataFrame:
    if not path.lower().endswith(".json"):
        raise ValueError("only .json files are accepted")
    return read_json_texts(spark, path)


def read_sql_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(query_key, sql): the upper-cased file stem and the whole text; missing files are skipped."""
    reader = spark.read.option("ignoreMissingFiles", "true")
    frames = []
    for p in paths:
        try:
            frames.append(reader.text(p, wholetext=True).select(F.upper(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("query_key"), F.col("value").alias("sql")))
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
    out = spark.createDataFrame([], "query_key string, sql string")
    for f in frames:
        out = out.unionByName(f)
    return out


def sql_dictionary(spark: SparkSession, queries: Mapping[str, str], metadata: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """(query_key, sql, view_name, metadatakey, regulation, class_name); the view is named after the key by default."""
    fields = ("view_name", "metadatakey", "regulation", "class_name")
    q = spark.createDataFrame(list(queries.items()), "query_key string, sql string")
    rows = [(k, *(m.get(f) for f in fields)) for k, m in (metadata or {}).items()]
    m = spark.createDataFrame(rows, "query_key string, " + ", ".join(f"{f} string" for f in fields))
    joined = q.join(m, "query_key", "left")
    return joined.select("query_key", "sql", F.coalesce("view_name", "query_key").alias("view_name"), *[F.coalesce(f, F.lit("")).alias(f) for f in fields[1:]])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text logs.

    Lines end at \\n, \\r\\n or \\r.  Numbers start at 0 in each file; what follows the last line end is a line
    only where it is not empty.  Large files are read in splits: within a split
    the lines come in order, and what the splits before it hold is added, so no
    file is gathered in one task.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")
    )
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = read.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return read.join(splits, ["file", "_start"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line_no"), "line")


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
