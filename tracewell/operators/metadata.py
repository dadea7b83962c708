"""Metadata catalogue: flatten, filter, count, compare branches, keep a registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants
from ..functions.text import b64_strict

QUERY = "struct<view_name: string, sql_query: string>"
RECORD = f"struct<id: string, name: string, regulation: string, stream: string, metadataType: string, value: struct<classname: string, create_query: array<{QUERY}>, select_query: {QUERY}>>"


def records(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """One row per record of {"metadataList": [..]}, a bare list, or a single object."""
    c = F.col(json)
    as_list = F.when(F.trim(c).startswith("["), F.from_json(c, f"array<{RECORD}>")).otherwise(
        F.coalesce(F.from_json(c, f"struct<metadataList: array<{RECORD}>>")["metadataList"], F.array(F.from_json(c, RECORD)))
    )
    return payloads.select("*", F.posexplode(as_list).alias("record_no", "record")).where(F.col("record").isNotNull()).select(*payloads.columns, "record_no", "record.*")


def flatten(recs: DataFrame) -> DataFrame:
    """One row per query of a record, decoded; create queries first, then the select query."""
    create = F.transform(F.coalesce(F.col("value.create_query"), F.array().cast(f"array<{QUERY}>")), lambda q, i: F.struct(F.lit("create").alias("kind"), i.alias("no"), q.alias("q")))
    select = F.when(F.col("value.select_query").isNotNull(), F.array(F.struct(F.lit("select").alias("kind"), F.lit(0).alias("no"), F.col("value.select_query").alias("q")))).otherwise(F.array().cast(f"array<struct<kind: string, no: int, q: {QUERY}>>"))
    return recs.select("name", "regulation", F.col("value.classname").alias("classname"), F.explode(F.concat(create, select)).alias("e")).select(
        "name", "regulation", "classname", "e.kind", "e.no", F.col("e.q.view_name").alias("view_name"), b64_strict(F.col("e.q.sql_query")).alias("sql")
    )


def walk(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """Queries at any depth of free-form payloads, each once.

    Every object with a view and a query counts; name and classname are its own or
    those of the nearest object around it that has some.
    """
    shape = "struct<name: string, classname: string, view_name: string, sql_query: string>"
    own = lambda e, name: F.coalesce(F.nullif(variants.text_at(e["keys"][name]), F.lit("")), e[name])
    text = lambda e, name: F.coalesce(variants.text_at(e["keys"][name]), F.lit("")).alias(name)

    def entry(name: Column, classname: Column, node: Column) -> Column:
        return F.struct(name.alias("name"), classname.alias("classname"), variants.members(node).alias("keys"), variants.items(node).alias("list"))

    def below(e: Column) -> Column:
        under = F.coalesce(F.map_values(e["keys"]), e["list"], F.array().cast("array<variant>"))
        return F.transform(under, lambda v: entry(own(e, "name"), own(e, "classname"), v))

    def found(e: Column) -> Column:
        here = F.map_contains_key(e["keys"], "view_name") & F.map_contains_key(e["keys"], "sql_query")
        row = F.struct(own(e, "name").alias("name"), own(e, "classname").alias("classname"), text(e, "view_name"), text(e, "sql_query"))
        return F.when(here, F.array(row)).otherwise(F.array().cast(f"array<{shape}>"))

    rows = variants.walk(F.col(json), lambda v: entry(F.lit(""), F.lit(""), v), below, found, shape)
    return payloads.select(F.explode(rows).alias("r")).select("r.*").distinct()


def matches(column: Column, wanted: str | Sequence[str] | None, lenient: bool = False) -> Column:
    """True without a wanted value; lenient: also where the row has none."""
    if not wanted:
        return F.lit(True)
    same = column.isin([wanted] if isinstance(wanted, str) else list(wanted))
    return same | (F.coalesce(column, F.lit("")) == "") if lenient else F.coalesce(same, F.lit(False))


def filter_records(df: DataFrame, lenient: bool = False, **wanted: str | Sequence[str] | None) -> DataFrame:
    """Rows that match every given column; empty values filter nothing."""
    for column, value in wanted.items():
        df = df.where(matches(F.col(column), value, lenient))
    return df


def class_by_regulation(df: DataFrame, regulation: str, order_by: Sequence[str]) -> DataFrame:
    """The class of the first record of a regulation, in file order."""
    return df.where(F.col("regulation") == regulation).orderBy(*order_by).limit(1).select("classname")


def snapshot(df: DataFrame, name: str, value: str, order_by: Sequence) -> DataFrame:
    """name -> value of a branch: the last of equal names, empty names dropped."""
    last = F.row_number().over(Window.partitionBy(name).orderBy(*[F.desc(c) for c in order_by]))
    return df.where(F.coalesce(F.col(name), F.lit("")) != "").withColumn("_n", last).where("_n = 1").select(F.col(name).alias("name"), F.col(value).alias("value"))


def canonical_json(c: Column) -> Column:
    """JSON text with keys in order, so that equal objects have equal texts."""
    return F.coalesce(F.try_parse_json(c).cast("string"), c)


def diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(name, change) of two snapshots: new, purged or diff; equal ones are left out."""
    a = new.select("name", canonical_json(F.col("value")).alias("a"), F.lit(True).alias("in_a"))
    b = old.select("name", canonical_json(F.col("value")).alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_b").isNull(), "new").when(F.col("in_a").isNull(), "purged").when(~F.col("a").eqNullSafe(F.col("b")), "diff")
    return a.join(b, "name", "full_outer").select("name", change.alias("change")).where("change IS NOT NULL")


def counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.sort_array(F.collect_set("name")).alias("names"))


def registry_id(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in columns]), 256)


def upsert(registry: DataFrame, found: DataFrame) -> DataFrame:
    """New mappings added, known ones refreshed; the status a user gave is kept.  Both have id and status."""
    kept = registry.select(F.col("id"), F.col("status").alias("_status"))
    fresh = found.join(kept, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    return registry.join(found.select("id"), "id", "left_anti").unionByName(fresh)


def na_filter(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without rows whose columns are all N/A."""
    every = F.lit(True)
    for c in columns:
        every &= F.col(c) == "N/A"
    return df.where(~every)
