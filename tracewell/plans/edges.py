"""Edge-graph lineage: (source entity, target entity) rows, static values included."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.python import statements
from .lineage import MAP_CALL, Walker
from .shapes import ShapeTable
from .sqlparse import Node, Reader, bare, parse, tokens

#: Fixed values.
DUMMY_TARGET = "dummy.dummy_table"
NOT_TABLES = ["select", "from", "where", "join", "on", "group", "order", "having", "union", "limit", "unknown"]
AMBIGUOUS_TABLES = ["", "N/A", "unknown", "unknown_target"]
VALUES = ["source_db", "source_table", "source_column", "target_db", "target_table", "target_column", "edge_type"]
ROWS = "ordinal int, " + "".join(f"{v} string, " for v in VALUES) + "status string"


def target_of(sql: str) -> tuple[str, str]:
    """(db, table) that the statement writes; the dummy table for a bare SELECT."""
    t = tokens(sql)
    words = [x.upper() for _, x in t[:9]]
    for k, w in enumerate(words[:8]):
        if w in ("INTO", "OVERWRITE", "TABLE", "VIEW") and k + 1 < len(words) and words[k + 1] not in ("TABLE", "INTO", "IF"):
            r = Reader("")
            r.t, r.i = t, k + 1
            if r.name_ahead():
                parts = [r.name()]
                while r.take("."):
                    parts.append(r.name())
                return (parts[-2] if len(parts) > 1 else "", parts[-1])
        if w in ("SELECT", "WITH"):
            break
    db, table = DUMMY_TARGET.split(".")
    return db, table


def output_blocks(node: Node) -> Iterator[Node]:
    if node.left:
        yield from output_blocks(node.left)
        yield from output_blocks(node.right)
    else:
        yield node


def edges_of(sql: str) -> Iterator[tuple]:
    """Edges of one statement; clauses other than SELECT and joins play no part."""
    root = parse(sql)
    walker, (db, table) = Walker(root), target_of(sql)
    for block in output_blocks(root):
        local = walker.local(block)
        for k, (item, alias) in enumerate(block.items):
            column = alias or (item.columns[0][1] if item.kind == "column" else "*" if item.kind == "star" else f"col_{k}")
            columns = [("", "*")] if item.kind == "star" else walker.deep_columns(item)
            for qualifier, name in columns:
                place = walker.found(qualifier, local)
                yield (place.db if place else "", place.table or place.alias if place else "unknown", name.lower(), db, table, column.lower(), "column")
            loose = [bare(("string", v)) if v.startswith("'") else v for v in item.literals] if item.kind in ("other", "case", "function") else []
            for value in loose if item.static is None else item.static:
                yield ("static", "static_value", value, db, table, column.lower(), "static")


def edges_or_status(text: str) -> list[tuple[tuple[str, ...], str]]:
    """(values, status) of a text's edges, repeats included; one row of blanks for texts that are empty, no SQL, skipped or without edges."""
    text, found, status = text.strip(), [], "no_edges_extracted"
    if not text:
        status = "EMPTY"
    elif text[0] in "{[":
        status = "non_sql"
    elif MAP_CALL.search(text):
        status = "map_skipped"
    else:
        try:
            found = [e for s in statements(text) for e in edges_of(s)]
        except Exception:  # noqa: BLE001  one text never stops the others
            status = "lineage_failed"
    return [(e, "success") for e in found] or [(("",) * len(VALUES), status)]


def edge_lineage(queries: DataFrame, sql: str = "sql", keep: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Edges of all statements of each text; a status row for texts that are empty, no SQL, skipped or without edges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = ShapeTable(edges_or_status, len(VALUES))
        for b in batches:
            at, ordinals, columns, status = [], [], [[] for _ in VALUES], []
            for i, text in enumerate(b.column(len(keep)).to_pylist()):
                begin = len(status)
                n = shapes.append(text or "", columns, status)
                # Repeats are told by what the text has, as a made name or value may equal one that it holds.
                different = dict.fromkeys(zip(*[c[begin:] for c in columns], strict=True))
                if len(different) < n:
                    for column, values in zip(columns, zip(*different, strict=True), strict=True):
                        column[begin:] = values
                    n = len(different)
                    del status[begin + n :]
                at += [i] * n
                ordinals += range(n)
            kept = [b.column(i).take(pa.array(at, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ordinals, pa.int32()), *[pa.array(c, pa.string()) for c in (*columns, status)]], names=[*keep, "ordinal", *VALUES, "status"])

    source = queries.select(*keep, sql)
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    # Reading costs far more than the bytes of a text tell, so the rows are spread over all tasks first.
    found = source.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(rows, kept + ROWS)
    return sanitise(found)


def sanitise(edges: DataFrame) -> DataFrame:
    """Keywords taken for tables become N/A; ``ambiguous`` says that the table is not known."""
    table = F.when(F.lower("source_table").isin(NOT_TABLES), "N/A").otherwise(F.col("source_table"))
    return edges.withColumn("source_table", table).withColumn("ambiguous", (F.col("status") == "success") & F.col("source_table").isin(AMBIGUOUS_TABLES))


def payload_queries(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """(query_key, sql) of create_query entries under any accepted key name; keys are made where there are none."""
    variants = lambda obj, *names: F.coalesce(*[F.try_variant_get(obj, f"$.{n}", "string") for n in names])
    v = F.try_parse_json(json)
    body = F.coalesce(F.try_variant_get(v, "$.value.create_query", "variant"), F.try_variant_get(v, "$.create_query", "variant"))
    as_text = F.to_json(body)
    items = F.from_json(F.when(as_text.startswith("["), as_text).otherwise(F.concat(F.lit("["), as_text, F.lit("]"))), "array<variant>")
    name = F.coalesce(variants(v, "name", "view_name", "metadatakey"), F.lit("VIEW"))
    q = F.col("item")
    return payloads.select(name.alias("name"), F.posexplode(items).alias("no", "item")).select(
        F.coalesce(variants(q, "query_key", "key", "view_name"), F.format_string("%s__CREATE__%d", F.upper("name"), F.col("no"))).alias("query_key"),
        variants(q, "query", "sql", "sql_query").alias("sql"),
    ).where("sql IS NOT NULL")
