"""Layered lineage: source, inner query alias and subquery rows per output column; tracing through subqueries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import Walker
from .sqlparse import Expr, Node, Source, parse

#: Name parts that don't tell columns apart.
IGNORED = {"EMP", "TBL", "DIM", "FACT", "ACTV"}
WINDOW = re.compile(r"\bover\s*\(", re.I)


def output_name(item: Expr, alias: str) -> str:
    return alias or (item.columns[0][1] if item.kind == "column" else "*" if item.kind == "star" else item.text)


def is_star(item: Expr) -> bool:
    return item.kind == "star" or item.kind == "column" and item.columns[0][1] == "*"


def star_of(item: Expr) -> str:
    return "" if item.kind == "star" else item.columns[0][0]


def name_score(outer: str, inner: str) -> int:
    """1000 for equal names, 100 and 90 for one within the other, 50 for half of the tokens shared, else 0."""
    a, b = outer.upper(), inner.upper()
    if a == b:
        return 1000
    if a in b:
        return 100
    if b in a:
        return 90
    x, y = ({t for t in s.split("_") if t and t not in IGNORED} for s in (a, b))
    return 50 if x and y and 2 * len(x & y) >= max(len(x), len(y)) else 0


def column_remark(item: Expr, db: str, table: str, n_tables: int) -> str:
    if re.search(r"\b(map|create_map)\s*\(", item.text, re.I):
        return "Spark complex SQL -MAP function"
    if WINDOW.search(item.text):
        return "derived_column_window_function"
    if item.kind in ("other", "case", "function"):
        return "derived_column" if item.columns else "constant_value"
    if not table and n_tables > 1:
        return "table_name_ambiguous"
    return "column_selected_with_database" if db else "database_not_specified_in_query"


def layers_of(sql: str) -> Iterator[tuple]:
    """(layer, db, table, table alias, column, alias, remark)."""
    root = parse(sql)
    walker = Walker(root)

    def emit(block: Node) -> Iterator[tuple]:
        local = walker.local(block)
        inner = block.sources[0] if len(block.sources) == 1 and block.sources[0].query else None
        below = [(output_name(e, a), e) for n in ([inner.query] if inner else []) if n.op == "select" for e, a in n.items]
        for item, alias in block.items:
            name = output_name(item, alias)
            for q, c in [("", "*")] if item.kind == "star" else item.columns or [("", item.text)]:
                place = walker.found(q, local) if item.columns or item.kind == "star" else None
                db, table = (place.db, place.table) if place else ("", "")
                yield 1, db, table, place.alias if place else q, c, alias, column_remark(item, db, table, len(local))
                if inner:
                    yield 2, "", inner.alias, inner.alias, c, alias, "Inner Query Alias Layer"
                    if c == "*":
                        yield from ((3, db, table, inner.alias, n, n, "Subquery Layer") for n, _ in below)
                        continue
                    best = max(((name_score(c, n), -k, n) for k, (n, _) in enumerate(below)), default=(0, 0, ""))
                    if best[0]:
                        yield 3, db, table, inner.alias, best[2], name, "Subquery Layer"

    for node in root.walk():
        if node.op == "select" and node.sources:
            yield from emit(node)


def trace_of(sql: str, most_depth: int = 20) -> Iterator[tuple]:
    """(db, table, column, output, remarks): each output column followed through subqueries and CTEs to its sources.

    A star is the outputs of what it stands for, or ``*`` of a table.
    """
    root = parse(sql)
    ctes = {n.lower(): q for x in root.walk() for n, q in x.ctes}

    def query_of(s: Source) -> Node | None:
        return s.query or (ctes.get(s.table.lower()) if not s.db else None)

    def resolve(block: Node, qualifier: str, column: str, path: tuple[str, ...], depth: int) -> Iterator[tuple]:
        if depth > most_depth:
            yield "", "", column, (*path, "subquery_resolution_depth_exceeded")
            return
        sources = [s for s in block.all_sources() if not qualifier or s.key.lower() == qualifier.lower()]
        if len(sources) != 1:
            yield "", "", column, (*path, "invalid_table_alias" if qualifier else "table_name_ambiguous")
            return
        s = sources[0]
        below = query_of(s)
        if below is None:
            yield s.db, s.table, column, path
            return
        path = (*path, f"via_subquery:{s.key}")
        arms = [n for n in arms_of(below)]
        if any(a.op != "select" for a in arms):
            yield "", s.key, column, (*path, "subquery_not_select")
        for a in arms:
            if a.op != "select":
                continue
            hits = [e for e, al in a.items if output_name(e, al).lower() == column.lower()]
            stars = [e for e, _ in a.items if is_star(e)]
            if hits:
                for q, c in hits[0].columns:
                    yield from resolve(a, q, c, path, depth + 1)
            elif stars:
                yield from resolve(a, star_of(stars[0]), column, path, depth + 1)
            else:
                yield "", s.key, column, (*path, "subquery_output_column_not_found")

    def outputs(block: Node, qualifier: str, path: tuple[str, ...], depth: int) -> Iterator[tuple]:
        for s in block.all_sources():
            if qualifier and s.key.lower() != qualifier.lower():
                continue
            below = query_of(s)
            if below is None:
                yield s.db, s.table, "*", path, "*"
            elif depth > most_depth:
                yield "", s.key, "*", (*path, "subquery_resolution_depth_exceeded"), "*"
            else:
                through = (*path, f"via_subquery:{s.key}")
                for a in (n for n in arms_of(below) if n.op == "select"):
                    for item, alias in a.items:
                        if is_star(item):
                            yield from outputs(a, star_of(item), through, depth + 1)
                        for q, c in [] if is_star(item) else item.columns:
                            yield from ((*r, output_name(item, alias)) for r in resolve(a, q, c, through, depth + 1))

    for block in arms_of(root):
        for item, alias in block.items:
            if is_star(item):
                for db, table, column, path, name in outputs(block, star_of(item), (), 0):
                    yield db, table, column, name, list(path)
                continue
            for q, c in item.columns:
                for db, table, column, path in resolve(block, q, c, (), 0):
                    yield db, table, column, output_name(item, alias), list(path)


def arms_of(node: Node) -> Iterator[Node]:
    if node.left:
        yield from arms_of(node.left)
        yield from arms_of(node.right)
    else:
        yield node


def tables_columns_of(sql: str) -> Iterator[tuple[str, str, str]]:
    """(kind, qualifier, name) of all tables and columns of a query, flat."""
    root = parse(sql)
    found = [("table", s.db, s.table) for n in root.walk() for s in n.all_sources() if s.table]
    found += [("column", q, c) for n in root.walk() for e in n.exprs() for q, c in e.columns]
    yield from dict.fromkeys(found)


def joins_of(sql: str) -> Iterator[tuple[str, str, str, str]]:
    """(join type, db, table or alias, condition)."""
    for n in parse(sql).walk():
        for j in n.joins:
            yield j.kind, j.source.db, j.source.table or j.source.alias, j.on.text if j.on else ",".join(j.using)


def map_pairs_of(sql: str) -> Iterator[tuple[str, str, str]]:
    """(qualifier, column, key) of the values of MAP(k, v, ...): a value's columns under its key."""
    for n in parse(sql).walk():
        for e in n.exprs():
            for k, v in e.pairs:
                yield from ((q, c, k.text.strip("'\"")) for q, c in v.columns)


def _table(queries: DataFrame, sql: str, keep: str, of, names: list[str], types: list[str]) -> DataFrame:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, text in f.itertuples(index=False):
                try:
                    out += [[key, k, *r, "success"] for k, r in enumerate(of(text or ""))]
                except Exception:  # noqa: BLE001  one text never stops the others
                    out.append([key, 0, *[0 if t == "int" else [] if t.startswith("array") else "" for t in types], "failed"])
            yield pd.DataFrame(out, columns=[keep, "ordinal", *names, "status"])

    kind = dict(queries.dtypes)[keep]
    schema = ", ".join([f"{keep} {kind}", "ordinal int", *[f"{n} {t}" for n, t in zip(names, types, strict=True)], "status string"])
    return queries.select(keep, sql).mapInPandas(rows, schema)


def layered_lineage(queries: DataFrame, sql: str = "sql", keep: str = "query_id", in_order: bool = False) -> DataFrame:
    """The layers of each query; ``in_order`` sorts all of them by query and layer, which takes a shuffle."""
    names = ["layer_order", "databaseName", "tableName", "tableAliasName", "columnName", "aliasName", "remarks"]
    rows = _table(queries, sql, keep, layers_of, names, ["int"] + ["string"] * 6)
    return rows.orderBy(keep, "layer_order", "ordinal") if in_order else rows


def traced_lineage(queries: DataFrame, sql: str = "sql", keep: str = "query_id") -> DataFrame:
    return _table(queries, sql, keep, trace_of, ["databaseName", "tableName", "columnName", "aliasName", "remarks"], ["string"] * 4 + ["array<string>"])


def tables_and_columns(queries: DataFrame, sql: str = "sql", keep: str = "query_id") -> DataFrame:
    return _table(queries, sql, keep, tables_columns_of, ["kind", "qualifier", "name"], ["string"] * 3)


def joins(queries: DataFrame, sql: str = "sql", keep: str = "query_id") -> DataFrame:
    return _table(queries, sql, keep, joins_of, ["join_type", "databaseName", "tableName", "condition"], ["string"] * 4)


def map_pairs(queries: DataFrame, sql: str = "sql", keep: str = "query_id") -> DataFrame:
    return _table(queries, sql, keep, map_pairs_of, ["qualifier", "columnName", "aliasName"], ["string"] * 3)


def only_failures(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") != "success")
