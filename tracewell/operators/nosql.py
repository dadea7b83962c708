"""Field lineage of Mongo operations and Elastic queries."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import variants
from ..functions.python import row_of

#: Clause kinds that name fields, and the parts of a bool query.
FIELD_CLAUSES = ("match", "match_phrase", "term", "range", "exists", "prefix", "wildcard")
BOOL_PARTS = ("must", "should", "filter", "must_not")
#: Kinds whose body may be the field itself, bounds of a range in the order of their text, remark of other clauses.
WITH_PLAIN_BODY = ("match", "match_phrase", "term")
BOUNDS = ("from", "gte", "gt", "to", "lte", "lt")
PLAIN = "Mongo query"


def projected(entries: dict, included: str, computed: str) -> Iterator[tuple[str, str, str]]:
    """(column, alias, remark): a field set to 1 is included, others are computed under their name."""
    for name, value in entries.items():
        plain = value == 1 and isinstance(value, int)
        yield name, "" if plain else name, included if plain else computed


def mongo_rows(op: dict) -> Iterator[tuple[str, str, str, str]]:
    """(collection, column, alias, remark) of one find or aggregate operation."""
    collection = op.get("collection") or ""
    if op.get("op") == "find":
        found = projected(op["projection"], "Mongo Query", "Mongo Query") if op.get("projection") else [("*", "", "Mongo query")]
        yield from ((collection, *r) for r in found)
    elif op.get("op") == "aggregate":
        for stage in op.get("pipeline") or []:
            if "$project" in stage:
                yield from ((collection, *r) for r in projected(stage["$project"], "project_included", "project_computed"))
            elif "$lookup" in stage:
                other = stage["$lookup"].get("from")
                yield collection, f"$lookup->{other}", stage["$lookup"].get("as", other) or "", "lookup_join"


def _json(text: str):
    try:
        return json.loads(text or "null")
    except ValueError:
        return None


@udtf(returnType=row_of("ordinal:int", "tableName", "columnName", "aliasName", "remark"))
class MongoLineage:
    def eval(self, operation: str):
        op = _json(operation)
        for k, r in enumerate(mongo_rows(op) if isinstance(op, dict) else []):
            yield k, *r


def mongo_lineage(df: DataFrame, column: str, *keep: str) -> DataFrame:
    return df.select(*keep, column).lateralJoin(MongoLineage(F.col(column).outer())).drop(column)


FIELD = "struct<columnName: string, clause: string, remark: string>"
CLAUSE = "struct<path: array<int>, row: struct<columnName: string, clause: string, remark: string>>"
NO_FIELDS = f"array<{FIELD}>"


def _field(name: Column, kind: str, remark: Column | None = None) -> Column:
    return F.struct(name.alias("columnName"), F.lit(kind).alias("clause"), (F.lit(PLAIN) if remark is None else remark).alias("remark"))


def range_text(body: Column) -> Column:
    """The bounds of a range as text; the plain remark without any."""
    bounds = F.concat_ws(",", *[F.concat(F.lit(f"{b}="), variants.text_at(body, f"$.{b}")) for b in BOUNDS])
    return F.when(bounds != "", F.concat(F.lit("range:"), bounds)).otherwise(PLAIN)


def clause_fields(keys: Column) -> Column:
    """The fields that a clause of these keys names: those of the first known kind it has, else keys whose value looks like a clause's."""
    none = F.array().cast(NO_FIELDS)
    found = F.when(keys.isNull(), none)
    for kind in FIELD_CLAUSES:
        body = keys[kind]
        inside = variants.members(body)
        if kind == "exists":
            name = F.coalesce(F.nullif(variants.text_at(body, "$.field"), F.lit("")), variants.text_at(body, "$.name"), F.lit(""))
            named = F.when(inside.isNotNull(), F.array(_field(name, kind))).otherwise(none)
        else:
            remark = range_text if kind == "range" else lambda v: None
            plain = F.array(_field(F.coalesce(variants.text_at(body), F.lit("")), kind)) if kind in WITH_PLAIN_BODY else none
            each = F.transform(F.map_entries(inside), lambda e: _field(e["key"], kind, remark(e["value"])))
            named = F.when(inside.isNotNull(), each).otherwise(plain)
        found = found.when(F.map_contains_key(keys, kind), named)
    loose = F.filter(F.map_entries(keys), lambda e: F.coalesce(F.array_join(F.map_keys(variants.members(e["value"])), ",").isin("query", "value", "match"), F.lit(False)))
    return found.otherwise(F.transform(loose, lambda e: _field(e["key"], "unknown")))


def elastic_fields(text: Column) -> Column:
    """Fields of a query's clauses in their order, bools followed to any depth; must, should, filter and must_not in this order."""

    # A VARIANT is built anew, with all below it, wherever one is taken out of another: once a level here.
    def entry(path: Column, node: Column) -> Column:
        return F.struct(path.cast("array<int>").alias("path"), node.alias("node"), variants.has_key(node, "bool").alias("bool"))

    def below(e: Column) -> Column:
        parts = []
        for n, part in enumerate(BOOL_PARTS):
            alone = F.filter(F.array(variants.at(e["node"], f"$.bool.{part}")), lambda v: v.isNotNull())
            clauses = F.coalesce(variants.items(e["node"], f"$.bool.{part}"), alone)
            parts.append(F.transform(clauses, lambda c, i: entry(F.concat(e["path"], F.array(F.lit(n), i)), c)))
        return F.when(e["bool"], F.concat(*parts)).otherwise(F.array().cast("array<struct<path: array<int>, node: variant, bool: boolean>>"))

    def found(e: Column) -> Column:
        fields = F.flatten(F.transform(F.array(variants.members(e["node"])), clause_fields))
        rows = F.transform(fields, lambda r, i: F.struct(F.concat(e["path"], F.array(i)).alias("path"), r.alias("row")))
        return F.when(e["bool"], F.array().cast(f"array<{CLAUSE}>")).otherwise(rows)

    def first(root: Column) -> Column:
        return entry(F.array(), F.when(variants.has_key(root, "query"), variants.at(root, "$.query")).otherwise(root))

    return F.transform(F.array_sort(variants.walk(text, first, below, found, CLAUSE)), lambda r: r["row"])


def elastic_lineage(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per field of a query: ordinal, columnName, clause, remark (the bounds of a range)."""
    return df.select(*keep, F.posexplode(elastic_fields(F.col(column))).alias("ordinal", "r")).select(*keep, "ordinal", "r.*")
