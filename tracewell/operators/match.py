"""Fuzzy matching of mapper fields to lineage rows.

The all-pairs comparison becomes an equi-join on meaningful tokens: a pair
passes the gate exactly when it shares one.  What is joined are distinct names,
not rows; each pair of names comes out of the join once, at its least shared
token, and tokens that very many names have are split.  Letter counts bound the
ratio from above, so that only pairs which may reach the threshold are compared,
and others only for fields that nothing reaches it for.  Rows are attached last.
"""

from __future__ import annotations

import functools
import operator
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.python import percent_udf, ratio_udf
from ..functions.text import meaningful, norm
from ..schemas import MATCH_FIELDS
from ..shared import settled

#: Least score of a match; database part that marks staging tables; the application's name in winkeys.
THRESHOLD = 40.0
STAGING = "gfolyreg_work"
APPLICATION = "olympusApplication"
#: Letters and digits of normalised names.
ALPHABET = string.ascii_uppercase + string.digits
#: Names that one task takes of a token.
HOT = 50_000
WINDATA = {"db": "a1", "table": "a2", "table_alias": "a3", "column": "a4", "alias": "a5", "file": "a6", "view": "a7"}
WINDATA_COMPAT = WINDATA | {"db": "a3", "alias": "a6"}


def _payload_id(by: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in by]


def flatten_facts(payloads: DataFrame, json: str = "payload", compat: bool = False, by: Sequence[str] = (), application: str = APPLICATION, keep: Sequence[str] = ()) -> DataFrame:
    """One row per windata item of factContainers, with its winkeys.

    ``row_no`` numbers the items of one payload.  With ``by``, columns that name
    a payload, it is a struct of these and both positions, so that rows of many
    payloads can be told apart.  ``application``: the name of the application in
    winkeys; ``keep``: columns of the payload to carry along.
    """
    names = [f"a{i}" for i in range(1, 8)]
    row = "struct<" + ", ".join(f"{n}: string" for n in names) + ", lxl: array<string>, lal: array<string>>"
    keys = f"struct<currBranch: string, id: string, version: string, `{application}`: string, windowType: string>"
    shape = f"struct<totalRecords: int, factContainers: array<struct<windata: array<{row}>, winkeys: {keys}>>>"
    of = WINDATA_COMPAT if compat else WINDATA
    ids = [f"_{c}" for c in by]
    number = F.struct(*ids, "c_no", "r_no") if by else (F.col("c_no") * 1_000_000 + F.col("r_no")).cast("long")
    return (
        payloads.select(*keep, *_payload_id(by), F.from_json(json, shape).alias("p"))
        .select(*keep, *ids, F.posexplode("p.factContainers").alias("c_no", "c")).select(*keep, *ids, "c_no", "c.winkeys", F.posexplode("c.windata").alias("r_no", "r"))
        .select(
            *keep, number.alias("row_no"),
            *[F.coalesce(F.col(f"r.{a}"), F.lit("")).alias(n) for n, a in of.items()],
            F.coalesce("r.lal", "r.lxl", F.array().cast("array<string>")).alias("actions"), F.col("winkeys").getField(application).alias("application"),
        )
    )


def mapper_fields(payloads: DataFrame, json: str = "payload", by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """One row per mapped column.  ``field_no`` numbers those of one payload; with ``by`` it is a struct of these columns and the position."""
    shape = "struct<name: string, value: struct<table_columns: array<struct<column_name: string, field: string, column_type: string>>>>"
    ids = [f"_{c}" for c in by]
    number = F.struct(*ids, "f_no") if by else F.col("f_no")
    return payloads.select(*keep, *_payload_id(by), F.from_json(json, shape).alias("p")).select(*keep, *ids, F.posexplode("p.value.table_columns").alias("f_no", "f")).select(
        *keep, number.alias("field_no"), F.coalesce("f.column_name", F.lit("")).alias("mapperColumn"), F.coalesce("f.field", F.lit("")).alias("mapperFactField")
    )


def usable(rows: DataFrame, staging: str | None = STAGING) -> DataFrame:
    """Rows with a database and a column that is no star; databases whose name holds ``staging`` are left out."""
    name = F.when(F.trim("alias") != "", F.col("alias")).otherwise(F.col("column"))
    found = rows.where((F.col("db") != "") & (F.trim(name) != "*"))
    return found.where(~F.lower("db").contains(staging.lower())) if staging else found


def _keys(fields: DataFrame, rows: DataFrame) -> list[str]:
    return ["key"] if "key" in fields.columns and "key" in rows.columns else []


def _named(rows: DataFrame) -> DataFrame:
    """Rows with ``_al`` and ``_co``, their alias and column without nulls."""
    return rows.select("*", F.coalesce("alias", F.lit("")).alias("_al"), F.coalesce("column", F.lit("")).alias("_co"))


def name_pairs(fields: DataFrame, rows: DataFrame, compat: bool = False, hot: int = HOT) -> DataFrame:
    """Pairs of distinct names that pass the gate: mapperColumn, _al, _co, second, compared, both normalised names _a and _b.

    ``second`` is 1 where only the column shares a token with the field.  A token
    of more than ``hot`` names is dealt to several tasks, to each of which its
    fields are sent.
    """
    by = _keys(fields, rows)
    wanted = fields.where(F.coalesce(F.col("mapperColumn"), F.lit("")) != "").select(*by, "mapperColumn").distinct().withColumn("_tf", meaningful(F.col("mapperColumn")))
    has_alias = F.trim("_al") != ""
    names = _named(rows).select(*by, "_al", "_co").distinct().withColumn("_t1", meaningful(F.when(has_alias, F.col("_al")).otherwise(F.col("_co"))))
    names = names.withColumn("_tr", F.when(has_alias & (F.trim("_co") != "*"), F.array_union("_t1", meaningful(F.col("_co")))).otherwise(F.col("_t1")))
    offered = names.withColumn("t", F.explode("_tr"))
    parts = names.select(F.explode("_tr").alias("_hot")).groupBy("_hot").count().where(F.col("count") > hot).select("_hot", F.ceil(F.col("count") / hot).cast("int").alias("_parts"))
    many = F.coalesce("_parts", F.lit(1))
    offered = offered.join(parts, F.col("t") == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64("_al", "_co"), many).cast("int")).drop("_hot", "_parts")
    asked = wanted.withColumn("t", F.explode("_tf")).join(parts, F.col("t") == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_hot", "_parts")
    met = asked.join(offered, [*by, "t", "_salt"]).where(F.array_min(F.array_intersect("_tf", "_tr")) == F.col("t"))
    second = F.when(F.arrays_overlap("_tf", "_t1"), 0).otherwise(1)
    compared = F.when(has_alias & ((F.col("second") == 0) | F.lit(compat)), F.col("_al")).otherwise(F.col("_co"))
    return met.withColumn("second", second).withColumn("compared", compared).select(
        *by, "mapperColumn", "_al", "_co", "second", "compared", norm(F.col("mapperColumn")).alias("_a"), norm(F.col("compared")).alias("_b")
    )


def common_letters(a: Column, b: Column) -> Column:
    """The number of letters and digits that two normalised names share at most; all other signs count as alike."""
    each = [F.least(F.length(a) - F.length(F.replace(a, F.lit(c))), F.length(b) - F.length(F.replace(b, F.lit(c)))) for c in ALPHABET]
    others = F.least(*[F.length(F.translate(x, ALPHABET, "")) for x in (a, b)])
    return functools.reduce(operator.add, each, others)


def differing(pairs: DataFrame) -> DataFrame:
    """Distinct (_a, _b) of names that differ, dealt to all tasks: comparing them takes far longer than their bytes tell."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.where("_a <> _b").select("_a", "_b").repartition(tasks, "_a", "_b").distinct()


def most_ratio(pairs: DataFrame) -> DataFrame:
    """Distinct (_a, _b) of names that differ, with ``_most``: no ratio of theirs is above it."""
    each = differing(pairs)
    return each.withColumn("_most", 200.0 * common_letters(F.col("_a"), F.col("_b")) / (F.length("_a") + F.length("_b")))


def _rated(pairs: DataFrame) -> DataFrame:
    """Distinct (_a, _b) with score and percent."""
    return pairs.withColumn("score", F.least(ratio_udf("_a", "_b"), F.lit(99.0))).withColumn("percent", percent_udf("score")).select("_a", "_b", "score", "percent")


def _exact(pairs: DataFrame) -> DataFrame:
    return pairs.where("_a = _b").withColumn("score", F.lit(100.0)).withColumn("percent", F.lit("100.0%"))


def _attached(pairs: DataFrame, fields: DataFrame, rows: DataFrame) -> DataFrame:
    """Fields and rows of pairs of names."""
    by = _keys(fields, rows)
    return pairs.join(fields, [*by, "mapperColumn"]).join(_named(rows).drop(*([] if by else ["key"])), [*by, "_al", "_co"])


def gate(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """(field, row, compared) pairs that share a meaningful token by alias or, failing that, by column.

    ``fields``: field_no, mapperColumn; ``rows``: row_no, column, alias.  Where both
    have a column ``key``, only fields and rows of one key meet; the numbers must
    then be unique over all keys.
    """
    by = _keys(fields, rows)
    return _attached(name_pairs(fields, rows), fields.select(*by, "field_no", "mapperColumn"), rows.select(*by, "row_no", "column", "alias")).select("field_no", "row_no", "second")


def match_columns(
    fields: DataFrame, rows: DataFrame, key: str = "", regulation: str = "", threshold: float = THRESHOLD, compat: bool = False, staging: str | None = STAGING
) -> DataFrame:
    """Every row at or above the threshold; else the best weak one; else a no_match row, per field.

    ``fields``: field_no, mapperColumn, mapperFactField; ``rows``: row_no, db,
    table, column, alias, optionally application.  The score compares the name
    that passed the gate (``compat``: the alias when there is one).  Weak ties go
    to the longer compared name, then the first row.  A whole registry is matched
    at once when both sides have a column ``key``.
    """
    rows = usable(rows, staging)
    by = _keys(fields, rows)
    pairs = settled(name_pairs(fields, rows, compat))
    # Only names whose letters allow it are compared; what reaches the threshold is a match of the field.
    near = _rated(most_ratio(pairs).where(F.col("_most") >= threshold - 1e-6)).where((F.col("score") >= threshold) & (F.col("score") > 0))
    strong = settled(_exact(pairs).unionByName(pairs.join(near, ["_a", "_b"])).drop("second"))
    # Fields without one take the best of all their pairs, of equal ones that with the first row.
    left = pairs.where("_a <> _b").join(strong.select(*by, "mapperColumn").distinct(), [*by, "mapperColumn"], "left_anti")
    first = _named(rows).groupBy(*by, "_al", "_co").agg(F.min("row_no").alias("row_no"))
    faint = left.join(_rated(differing(left)), ["_a", "_b"]).where("score > 0").join(first, [*by, "_al", "_co"])
    best = faint.groupBy(*by, "mapperColumn").agg(F.min(F.struct((-F.col("score")).alias("_s"), (-F.length("compared")).alias("_l"), "row_no", "compared", "score", "percent")).alias("_m"))
    weak = best.select(*by, "mapperColumn", "_m.row_no", "_m.compared", "_m.score", "_m.percent").join(fields, [*by, "mapperColumn"]).join(_named(rows).drop("key"), "row_no")
    found = _attached(strong, fields, rows)
    return _emit(found.unionByName(weak.select(*[c for c in found.columns if c in weak.columns]), allowMissingColumns=True), fields, key, regulation, threshold)


def match_registry(
    mappers: DataFrame, facts: DataFrame, by: Sequence[str] = ("key", "payload_no"), regulation: str = "", threshold: float = THRESHOLD, staging: str | None = STAGING
) -> DataFrame:
    """All mappers of a registry against the facts of the same key, straight from the payloads of both.

    Both sides have ``key``, ``payload`` and the columns ``by``, which name a
    payload within its side.  Numbers are taken over all payloads, so no field
    meets another's rows or loses its no_match row.
    """
    fields = mapper_fields(mappers, by=by, keep=("key",))
    rows = flatten_facts(facts, by=by, keep=("key",))
    return match_columns(fields, rows, regulation=regulation, threshold=threshold, staging=staging)


def scored(fields: DataFrame, rows: DataFrame, compat: bool = False) -> DataFrame:
    """All pairs of fields and rows that pass the gate, with score and percent."""
    pairs = name_pairs(fields, rows, compat)
    rated = _exact(pairs).unionByName(pairs.join(_rated(differing(pairs)), ["_a", "_b"]))
    return _attached(rated, fields, rows)


def _emit(pairs: DataFrame, fields: DataFrame, key: str, regulation: str, threshold: float) -> DataFrame:
    name = F.col("key") if "key" in fields.columns else F.lit(key)
    kind = F.when(F.col("score") == 100.0, "exact").when(F.col("score") >= threshold, "fuzzy").otherwise("weak")
    application = F.coalesce(F.col("application"), F.lit("")) if "application" in pairs.columns else F.lit("")
    found = pairs.select(
        "field_no", (F.lit(regulation) if regulation else application).alias("regulation"), name.alias("key"), "mapperColumn", "mapperFactField",
        F.col("db").alias("dbName"), F.col("table").alias("tableName"), F.col("column").alias("columnName"), F.col("alias").alias("columnAliasName"),
        F.when(F.col("compared") == F.col("alias"), "alias").otherwise("columnName").alias("matchedOn"), F.col("percent").alias("matchPercentage"), kind.alias("matchType"),
    )
    blank = F.lit("")
    none = fields.where(F.coalesce(F.col("mapperColumn"), F.lit("")) != "").join(found.select("field_no").distinct(), "field_no", "left_anti").select(
        "field_no", F.lit(regulation).alias("regulation"), name.alias("key"), "mapperColumn", "mapperFactField",
        *[blank.alias(c) for c in ("dbName", "tableName", "columnName", "columnAliasName", "matchedOn")], F.lit("0.0%").alias("matchPercentage"), F.lit("no_match").alias("matchType"),
    )
    return found.unionByName(none).select("field_no", *MATCH_FIELDS)


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The n first rows of each name (and key): rows of one name are equally good for a field, so that no others are among its n best."""
    named = Window.partitionBy(*[c for c in ("key",) if c in rows.columns], F.coalesce("alias", F.lit("")), F.coalesce("column", F.lit(""))).orderBy("row_no")
    return rows.withColumn("_nth", F.row_number().over(named)).where(F.col("_nth") <= n).drop("_nth")


def best_matches(fields: DataFrame, rows: DataFrame, n: int, compat: bool = False) -> DataFrame:
    """The n best rows of each field, as ``top_n`` of ``scored``; only rows that may be among them are paired with fields."""
    return top_n(scored(fields, first_rows(rows, n), compat), n)


def top_n(pairs: DataFrame, n: int) -> DataFrame:
    """The n best candidates of each field."""
    order = Window.partitionBy("field_no").orderBy(F.desc("score"), F.desc(F.length("compared")), "row_no")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def summary(matches: DataFrame) -> DataFrame:
    is_ = lambda t: F.count_if(F.col("matchType") == t).alias(t)
    return matches.agg(F.count(F.lit(1)).alias("total"), is_("exact"), is_("fuzzy"), is_("weak"), is_("no_match"))


def key_summary(matches: DataFrame) -> DataFrame:
    none = F.col("matchType") == "no_match"
    return matches.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.count_if(~none).alias("matched"), F.count_if(none).alias("no_match"))
