"""What can be said of texts that the reader cannot read: tables and references found as islands among lexemes."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import AMBIGUOUS, FAILURE, NO_DB, WITH_DB
from .sqlparse import CLAUSES, JOINS, NOT_COLUMNS, UNITS, bare, parse, tokens

#: What stands in rows of empty and of hopeless texts, and for names that lead nowhere; names looked for without a qualifier.
PLACEHOLDER, ERROR, UNKNOWN = "N/A", "ERROR", "unknown"
BARE = re.compile(r"[A-Z][A-Z0-9_]{2,}")
BEFORE_TABLE = {"FROM", "JOIN", "INTO", "UPDATE"}
NAMES = ["databaseName", "tableName", "columnName", "remark", "status"]


def chains(sql: str) -> list[tuple[list[str], str, str, bool]]:
    """(parts, word before, word after, plain) of each dotted name; plain ones are single unquoted words."""
    found, t, i = [], tokens(sql), 0
    while i < len(t):
        if t[i][0] not in ("word", "quoted"):
            i += 1
            continue
        begin, parts = i, [bare(t[i])]
        while i + 2 < len(t) and t[i + 1][1] == "." and t[i + 2][0] in ("word", "quoted") or i + 2 < len(t) and t[i + 1][1] == "." and t[i + 2][1] == "*":
            parts.append(bare(t[i + 2]))
            i += 2
        i += 1
        found.append((parts, t[begin - 1][1] if begin else "", t[i][1] if i < len(t) else "", len(parts) == 1 and t[begin][0] == "word"))
    return found


def islands(sql: str) -> list[tuple[str, str, str, str]]:
    """(db, table, column, remark) of the references in a text, each once.

    Tables stand behind FROM, JOIN, INTO and UPDATE, aliases behind them.
    ``a.b`` and longer names are references; so are upper-case words of three
    letters and more that are no keyword, call, table, alias, type or column found
    before, and not the text's first word.  A qualifier is an alias, else a table,
    else, in a name of three parts, a database; else its table is unknown.
    """
    found = chains(sql)
    tables: dict[str, tuple[str, str]] = {}
    names: dict[str, tuple[str, str]] = {}
    refs: list[tuple[list[str], bool]] = []
    taken: set[str] = set()
    waiting = None
    for k, (parts, before, after, plain) in enumerate(found):
        word = parts[0].upper()
        if plain and word in NOT_COLUMNS | CLAUSES | JOINS | BEFORE_TABLE | UNITS:
            waiting = waiting if word == "AS" else None
        elif before.upper() in BEFORE_TABLE and after != "(":
            place = (parts[0] if len(parts) > 1 else "", parts[2] if len(parts) > 2 else parts[-1])
            names.setdefault(place[1].lower(), place)
            waiting = place
        elif plain and waiting and before not in ("(", ")", ",", "=", "."):
            tables.setdefault(parts[0].lower(), waiting)
            waiting = None
        else:
            waiting = None
            if after != "(" and before.upper() != "AS" and (len(parts) > 1 or (plain and k and BARE.fullmatch(parts[0]))):
                refs.append((parts, plain))
    known = names | tables
    for parts, _ in refs:
        if len(parts) > 1:
            taken.update((parts[0], parts[-1]))
    bases = list(dict.fromkeys(names.values()))
    rows = []
    for parts, plain in refs:
        if plain:
            if parts[0] in taken or parts[0].lower() in known:
                continue
            place = bases[0] if len(bases) == 1 else (UNKNOWN, UNKNOWN)
            column = parts[0]
        elif parts[0].lower() in known:
            place, column = known[parts[0].lower()], ".".join(parts[1:])
        elif len(parts) > 2:
            place, column = (parts[0], parts[1]), ".".join(parts[2:])
        else:
            place, column = (UNKNOWN, parts[0]), parts[1]
        remark = AMBIGUOUS if UNKNOWN in place else WITH_DB if place[0] else NO_DB
        rows.append((*place, column, remark))
    return list(dict.fromkeys(rows))


def recovered(sql: str | None) -> list[tuple[str, str, str, str, str]]:
    """Rows of a text by islands; none where the reader can read it."""
    if not (sql or "").strip():
        return [(PLACEHOLDER, PLACEHOLDER, PLACEHOLDER, "empty query", "placeholder")]
    try:
        parse(sql)
    except Exception:  # noqa: BLE001  one text never stops the others
        rows = [(*r, "recovered") for r in islands(sql)]
        return rows or [(ERROR, ERROR, ERROR, FAILURE, "failed")]
    return []


def recovered_lineage(queries: DataFrame, sql: str = "sql", keep: str = "query_id") -> DataFrame:
    """``keep``, ordinal, database, table, column, remark and status of texts that cannot be read.

    Texts that the reader can read give no rows (``extract_lineage`` does them),
    empty and null ones a placeholder, and texts without any island an error row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = functools.lru_cache(maxsize=4096)(recovered)
        for b in batches:
            made = [(i, k, *r) for i, text in enumerate(b.column(1).to_pylist()) for k, r in enumerate(read(text))]
            at = pa.array([r[0] for r in made], pa.int64())
            columns = [pa.array([r[k] for r in made], pa.string()) for k in range(2, 7)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in made], pa.int32()), *columns], names=[keep, "ordinal", *NAMES])

    kind = dict(queries.dtypes)[keep]
    spread = queries.select(keep, F.col(sql)).repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(rows, f"`{keep}` {kind}, ordinal int, " + ", ".join(f"{n} string" for n in NAMES))
