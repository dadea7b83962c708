"""Texts that cannot be read, and expressions without columns."""

import pytest

from tracewell.plans.lineage import lineage_of
from tracewell.plans.recover import islands, recovered, recovered_lineage


def test_names_that_are_no_references():
    found = islands("SELECT COUNT(*), CAST(A_B AS INT) AS NEW_NAME, 'NOT_ME', -- NOR_ME\n T1.X, T1 FROM db.T1 WHERE ((")
    assert [r[:3] for r in found] == [("db", "T1", "A_B"), ("db", "T1", "X")]


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT a.b.c.d FROM x.y.z q WHERE q.k IN (", [("a", "b", "c.d"), ("x", "z", "k")]), ("UPDATE d.t SET q = ((( WHERE t.x = 1", [("d", "t", "x")]),
    ("SELECT s.* FROM (SELECT ONE_COL FROM d.t) s, ((", [("unknown", "s", "*"), ("d", "t", "ONE_COL")]), ("SELECT `A b`.c FROM t (", [("unknown", "A b", "c")]),
])
def test_where_qualifiers_lead(sql, want):
    assert [r[:3] for r in islands(sql)] == want


def test_marks(spark):
    texts = [(1, None), (2, " "), (3, "))"), (4, "SELECT a FROM t"), (5, "SELECT a.b FROM t a WHERE (("), (5, "SELECT a.b FROM t a WHERE ((")]
    got = sorted((r["query_id"], r["status"], r["tableName"]) for r in recovered_lineage(spark.createDataFrame(texts, "query_id int, sql string")).collect())
    assert got == [(1, "placeholder", "N/A"), (2, "placeholder", "N/A"), (3, "failed", "ERROR"), (5, "recovered", "t"), (5, "recovered", "t")]
    assert recovered("SELECT a FROM t") == []


def test_expressions_without_columns_keep_their_block():
    rows = lineage_of("SELECT 1 AS one, f() AS g, x.a FROM d.t x JOIN e.u y ON x.i = y.i", context=True)
    assert (["d", "t", "x", "1", "one"], ["derived_expression"]) in rows and (["d", "t", "x", "f()", "g"], ["derived_expression", "function_expression"]) in rows
    assert (["e", "u", "y", "1", "one"], ["derived_expression"]) in lineage_of("SELECT 1 AS one FROM d.t x JOIN e.u y ON x.i = y.i", context=True, prefer="Y")
    assert all(r[0][3] not in ("1",) for r in lineage_of("SELECT 1 AS one, a FROM d.t"))
    assert lineage_of("SELECT f() AS g", context=True) == [(["", "", "", "f()", "g"], ["derived_expression", "function_expression"])]
