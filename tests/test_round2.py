"""Rewriting by nesting, readers that never raise, numbers over many payloads, the guard before each request."""

import json
import random

import pytest

from tracewell.functions.rewrite import rewrite
from tracewell.operators import match
from tracewell.plans import edges
from tracewell.plans.corpus import TEMPLATES
from tracewell.plans.lineage import lineage_of, routed
from tracewell.queries import CALL_CASES
from tracewell.sources import http


@pytest.mark.parametrize(("given", "made"), CALL_CASES)
def test_rewrite_cases(given, made):
    assert rewrite(given.replace("{k}", "7")) == made.replace("{k}", "7")


def test_rewrite_leaves_what_it_does_not_know():
    for s in ("", "f(a, (b", "'open now()", "-- now()", '"len(x)"', "/* isnull( ", "a.len", "interval days", "offset rows", "date + 1", "group_concat(a, b, c)"):
        assert rewrite(s) == s
    deep = "(" * 5000 + "now()"
    assert rewrite(deep) == deep


def test_readers_never_raise(spark):
    """Pieces of statements put together at random: every text gives rows or a status."""
    rng = random.Random(5)
    words = [w for s, _ in TEMPLATES.values() for w in s.split()] + ["view", "INTO", "TABLE", "OVERWRITE", "'", "(", ")", "::", "\x00", "é", "CASE", "WITH", "`", ";", "--"]
    texts = ["UPDATE d1.t SET a = view WHERE c = 1", "(" * 3000, None, ""] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    for t in texts:
        routed(t)
        assert all(len(v) == 5 and isinstance(r, list) for v, r in lineage_of(t))
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, sql string")
    assert {r["query_id"] for r in edges.edge_lineage(df).select("query_id").distinct().collect()} == set(range(len(texts)))


def test_target_at_the_eighth_word():
    assert edges.target_of("UPDATE d1.t SET a = view WHERE c = 1") is not None
    assert edges.target_of("INSERT INTO a.b SELECT 1") == ("a", "b") and edges.target_of("SELECT 1") == ("dummy", "dummy_table")


def test_many_payloads_keep_their_fields_apart(spark):
    mapper = lambda *names: json.dumps({"name": "m", "value": {"table_columns": [{"column_name": n, "field": n} for n in names]}})
    fact = lambda *names: json.dumps({"factContainers": [{"windata": [{"a1": "db", "a2": "t", "a4": n} for n in names]}]})
    mappers = spark.createDataFrame([("k", 0, mapper("trade_date")), ("k", 1, mapper("city_zone")), ("other", 0, mapper("trade_date")), (None, 0, mapper("x_y"))], "key string, payload_no int, payload string")
    facts = spark.createDataFrame([("k", 0, fact("trade_date")), ("k", 1, fact("price_amount")), (None, 0, None)], "key string, payload_no int, payload string")
    got = {(r["key"], r["mapperColumn"], r["columnName"], r["matchType"]) for r in match.match_registry(mappers, facts).collect()}
    assert got == {("k", "trade_date", "trade_date", "exact"), ("k", "city_zone", "", "no_match"), ("other", "trade_date", "", "no_match"), (None, "x_y", "", "no_match")}


@pytest.mark.parametrize("url", ["https://db.local/", "https://a.internal/x", "https://q.localhost", "https://localhost./", "https://[::1]/", "https://[bad/", "ftp://x.org"])
def test_guard_refuses(url):
    with pytest.raises(http.UnsafeUrl):
        http.check_url(url)
    assert http.fetch(url, send=lambda *a: (200, "sent"))[0] == 403


def test_guard_judges_addresses_and_redirects():
    with pytest.raises(http.UnsafeUrl):
        http.check_url("https://public.org", resolve=lambda h: ["10.1.2.3"])
    with pytest.raises(http.UnsafeUrl):
        http.GuardedRedirects().redirect_request(None, None, 302, "", {}, "https://169.254.169.254/")


@pytest.mark.parametrize(("given", "made"), [
    ("select f(a\0) from t", "select f(a\0) from t"), ("select (a\0", "select (a\0"), ("select len(a, (b", "select len(a, (b"), ("select t.len(x), len(x) from t", "select t.len(x), length(x) from t"),
    ("PERCENTILE_CONT(0.3) WITHIN GROUP (ORDER BY x DESC) OVER ()", "PERCENTILE(x, 1 - 0.3)"), ("PERCENTILE_CONT(0.3) WITHIN GROUP (ORDER BY x asc) OVER ()", "PERCENTILE(x, 0.3)"),
])
def test_rewrite_of_odd_calls(given, made):
    assert rewrite(given) == made
