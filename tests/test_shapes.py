"""What is read of a shape and filled with a text's own digits is what is read of the text."""

import random

import pytest

from tracewell.plans import edges, lineage
from tracewell.plans.corpus import TEMPLATES
from tracewell.plans.lineage import lineage_of
from tracewell.plans.shapes import MARK, ShapeTable

ODD = [
    "SELECT a1, t1.A1, a01 FROM d1.t1 T1 JOIN d2.t01 ON t1.k9 = t01.k9", "SELECT 0x1f, 1e5, x'1f', 12ab0x1f, 5x1 AS k FROM t", "SELECT `5a5`, \"a5\" AS 'x5:{}' FROM `d5`.t5",
    "SELECT f5(9) AS {0} FROM t5", f"SELECT a{MARK}001, b1 FROM t{MARK}", "SELECT K5, k5, é5 FROM t5 x5, u5 y5", "WITH c1 AS (SELECT a FROM t2), c2 AS (SELECT a FROM c1) SELECT a FROM c2",
    "SELECT a٣, b5٣ FROM t5", "SELECT f(a5 % 3, '%s5') AS s5 FROM t5 WHERE x5 = ${p5} AND ##q5## = :r5", "SELECT 5.a5, -e5 FROM t_5 [b5]", "SELECT (", "",
    "SELECT " + ", ".join(f"c{k}" for k in range(1200)) + " FROM t7",
]


def read(texts):
    table = ShapeTable(lambda text: [(v, tuple(r)) for v, r in lineage_of(text)], 5)
    for text in texts:
        columns, tags = [[] for _ in range(5)], []
        n = table.append(text, columns, tags)
        assert n == len(tags)
        yield list(zip(*columns, tags, strict=True))
    assert table.prepared.cache_info().misses <= len(texts)


def test_rows_of_a_shape_are_those_of_its_texts():
    rng = random.Random(5)
    texts = [s.replace("{k}", str(k)) for s, _ in TEMPLATES.values() for k in (7, 0, 10, 123456789)] + ODD
    # The same texts with other digits, names made equal and unequal by chance.
    texts += ["".join(rng.choice("0125") if c.isdigit() and c.isascii() else c for c in text) for text in texts for _ in range(10)]
    for text, got in zip(texts, read(texts), strict=True):
        assert got == [(*v, tuple(r)) for v, r in lineage_of(text)], text


@pytest.mark.parametrize("spread", [True, False])
def test_texts_of_one_shape_are_read_once(spark, monkeypatch, spread):
    """A thousand statements that differ in one number: the reader sees one."""
    calls = []
    monkeypatch.setattr(lineage, "lineage_of", lambda *a: calls.append(a) or lineage_of(*a))
    table = ShapeTable(lambda text: [(v, tuple(r)) for v, r in lineage.lineage_of(text)], 5)
    columns, tags = [[] for _ in range(5)], []
    for k in range(1000):
        table.append(f"SELECT a{k}, b FROM d{k}.t", columns, tags)
    assert len(calls) == 1 and columns[3] == [c for k in range(1000) for c in (f"a{k}", "b")]
    made = spark.range(1000).selectExpr("id", "concat('SELECT a', id, ', b FROM d', id, '.t') AS sql", "'R' AS regulation", "'K' AS metadatakey", "'V' AS view_name")
    rows = lineage.extract_lineage(made, keep=("id",), spread=spread).orderBy("id", "ordinal").collect()
    assert [(r.id, r.ordinal, r.databaseName, r.columnName, r.remarks) for r in rows] == [
        (k, o, f"d{k}", c, ["column_selected_with_database"]) for k in range(1000) for o, c in enumerate((f"a{k}", "b"))]


def test_edges_of_a_shape(spark):
    """Texts of a shape give the edges of each text, repeats told by the text's own names; one task is not left with all of them."""
    odd = [
        "SELECT a5 + b5, a5 + b5 AS col_0 FROM t5", "SELECT a5 + b5, a5 + b5 AS col_1 FROM t5", "SELECT CASE WHEN x1 THEN date '5' ELSE 'DATE_5' END AS k1 FROM t",
        "", None, "{a5}", "SELECT (", "select map(a5, b5) from t", "INSERT INTO d1.t1 SELECT a1 FROM d2.t2; SELECT 'v1' || c1 AS z1 FROM e1.u1",
    ]
    texts = odd + [f"SELECT a{k}, 5 AS n{k % 3} FROM d{k}.t" for k in range(200)]
    made = spark.createDataFrame(list(enumerate(texts)), "query_id int, sql string").coalesce(1)
    found = edges.edge_lineage(made)
    assert found.rdd.getNumPartitions() == 4
    got = {}
    for r in found.orderBy("query_id", "ordinal").collect():
        got.setdefault(r.query_id, []).append(((*[r[v] for v in edges.VALUES],), r.status))
    unknown = lambda e: (*e[:1], "N/A" if e[1] == "unknown" else e[1], *e[2:])
    assert got == {i: [(unknown(e), s) for e, s in dict.fromkeys(edges.edges_or_status(text or ""))] for i, text in enumerate(texts)}
    assert len(got[0]) == 2 and len(got[1]) == 4
