import pytest

from tracewell import schemas as S
from tracewell.plans import edges, layers, lineage
from tracewell.plans.corpus import TEMPLATES
from tracewell.plans.lineage import lineage_of
from tracewell.plans.sqlparse import SqlError, parse


def distinct(sql, compat=False):
    return {(*v, "|".join(sorted(r))) for v, r in lineage_of(sql, compat)}


def rows(*items):
    return {("", table, alias, column, name, "|".join(sorted(remarks))) for table, alias, column, name, remarks in items}


@pytest.mark.parametrize("name", TEMPLATES)
def test_rule_templates(name):
    sql, want = TEMPLATES[name]
    fill = lambda x: x.replace("{k}", "7")
    assert distinct(fill(sql)) == {(*map(fill, r[:5]), "|".join(sorted(r[5].split("|")))) for r in want}


def test_golden_nvl_and_coalesce():
    assert distinct("select NVL(colA, colB) as test from table1") == rows(("table1", "", "cola", "test", [S.DERIVED]), ("table1", "", "colb", "test", [S.DERIVED]))
    sql = "SELECT k, COALESCE(p1, p2, p3, 'none') AS p, COALESCE(q1, q2) AS q FROM z"
    pairs = [("p1", "p"), ("p2", "p"), ("p3", "p"), ("q1", "q"), ("q2", "q")]
    assert distinct(sql) == rows(("z", "", "k", "", [S.NO_DB]), *[("z", "", c, a, [S.DERIVED]) for c, a in pairs])


def test_arithmetic_over_a_join():
    """Plain columns, columns of products, a division under a function, and both sides of the join."""
    sql = """SELECT f.trip, f.km, -- per trip
      f.km * f.rate AS fare, (f.rate - v.cost) / NULLIF(v.cost, 0) AS gain, f.km * 1.6 AS miles FROM trips f JOIN vans v ON f.van = v.van"""
    got = distinct(sql)
    assert {(r[1], r[3], r[4]) for r in got if S.DERIVED in r[5]} == {("trips", "km", "fare"), ("trips", "rate", "fare"), ("trips", "rate", "gain"), ("vans", "cost", "gain"), ("trips", "km", "miles")}
    assert {r[3] for r in got if S.NO_DB in r[5]} == {"trip", "km"}
    assert {(r[1], r[3]) for r in got if S.JOIN_ON in r[5]} == {("trips", "van"), ("vans", "van")}


def test_compat_join_type():
    sql = "SELECT a.x FROM t a LEFT JOIN u b ON a.i = b.i"
    assert any("join_type:LEFT" in r[5] for r in distinct(sql)) and any("join_type:INNER" in r[5] for r in distinct(sql, True))


def test_cte_with_union_and_quoted_aliases():
    sql = """WITH b AS (SELECT *, sha2(COMMENTS, 512) AS H, DENSE_RANK() OVER (PARTITION BY A.R ORDER BY D DESC) AS LR FROM M.LEDGER A WHERE UPPER(S) IN ('OPEN')),
    c AS (SELECT CONCAT('x', CAST(D AS STRING)) AS 'k:id', CASE WHEN '##P##' IN ('1') THEN 'M' END AS 'k:t', ROW_NUMBER() OVER (PARTITION BY F ORDER BY G DESC) AS LTO FROM b WHERE LR = 1)
    SELECT * FROM c WHERE LTO = 1 UNION SELECT * FROM b WHERE LTO = 2"""
    got = distinct(sql)
    assert ("m", "ledger") in {r[:2] for r in got if r[3] == "f"}
    assert {"where_clause_column"} <= {r[5] for r in got if r[3] == "lr"}
    assert any(r[3] == "d" and r[4] == "k:id" and r[0] == "m" for r in got)


def test_unreadable_and_empty_texts_give_one_failure_row():
    for sql in (None, "", "  ", "SELECT (", "select from", "hello", "SELECT a FROM t WHERE (b", "select a b c d from t"):
        assert lineage_of(sql) == [([""] * 5, [S.FAILURE])]
    with pytest.raises(SqlError):
        parse("SELECT a FROM")


def test_wide_query():
    sql = "SELECT " + ", ".join(f"c{i} + d{i} AS e{i}" for i in range(500)) + " FROM x.t"
    assert len(distinct(sql)) == 1000


def test_pipeline_and_dedup(spark):
    q = spark.createDataFrame([(1, "SELECT a.x FROM t a JOIN u b ON a.i = b.i", "R"), (2, None, "R"), (3, "SELECT 1", None)], "id int, sql string, regulation string").selectExpr("*", "'K' AS metadatakey", "'V' AS view_name")
    raw = lineage.extract_lineage(q, keep=("id",))
    assert [f.name for f in raw.schema] == ["id", "ordinal", *S.LINEAGE_FIELDS, "remarks"]
    assert raw.where("id = 1").count() == 5 and lineage.deduplicate(raw).where("id = 1").count() == 3
    assert lineage.deduplicate(raw).where("id = 2").count() == 1 and lineage.deduplicate(raw, keep_failures=False).where("id = 2").count() == 0
    assert lineage.extract_lineage(q.limit(0)).count() == 0
    assert lineage.titled(raw).columns[:3] == ["Database Name", "Table Name", "Table Alias Name"]


def test_trace_depth_guard_and_missing_columns():
    deep = "SELECT a FROM t"
    for i in range(25):
        deep = f"SELECT a FROM ({deep}) s{i}"
    assert any("subquery_resolution_depth_exceeded" in r[4] for r in layers.trace_of(deep))
    assert any("subquery_output_column_not_found" in r[4] for r in layers.trace_of("SELECT s.b FROM (SELECT a FROM t) s"))


def test_name_scores():
    assert [layers.name_score(a, b) for a, b in (("a_b", "A_B"), ("x_trade_y", "trade"), ("trade", "x_trade"), ("emp_id_one", "one_id"), ("a", "b"))] == [1000, 90, 100, 50, 0]


def test_edges_of_statements():
    got = list(edges.edges_of("insert into f.g select a as x, 'v' as k from d.t where z = 1"))
    assert got == [("d", "t", "a", "f", "g", "x", "column"), ("static", "static_value", "v", "f", "g", "k", "static")]
    assert edges.target_of("select 1") == ("dummy", "dummy_table") and edges.target_of("create table a.b as select 1") == ("a", "b")


@pytest.mark.parametrize(("item", "want"), [
    ("array[1, 2] as k", ["ARRAY_1_2"]), ("array[a, 2] as k", ["2"]), ("x'1F' as k", ["x'1F'"]), ("- 3 as k", ["-3"]), ("interval 1 hour as k", ["INTERVAL_1_HOUR"]),
    ("case when a = 'no' then 'yes' else b end as k", ["yes"]), ("case when a then f(1) when b then case when c then 2 else 3 end end as k", ["2", "3"]), ("concat(a, 'z') as k", ["z"]),
])
def test_static_values(item, want):
    assert [e[2] for e in edges.edges_of(f"select {item} from d.t") if e[0] == "static"] == want
