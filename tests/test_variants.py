"""Walks over VARIANT against plain recursion."""

import json
import random

from tracewell.operators import metadata, nosql

KINDS = ["match", "match_phrase", "term", "range", "exists", "prefix", "wildcard"]


def clause_by_hand(c):
    if not isinstance(c, dict):
        return []
    for kind in KINDS:
        if kind in c:
            body = c[kind]
            if kind == "exists":
                return [(body.get("field") or body.get("name") or "", kind, "Mongo query")] if isinstance(body, dict) else []
            if not isinstance(body, dict):
                return [(str(body), kind, "Mongo query")] if kind in KINDS[:3] else []
            bounds = {f: [f"{b}={v[b]}" for b in ("from", "gte", "gt", "to", "lte", "lt") if kind == "range" and isinstance(v, dict) and b in v] for f, v in body.items()}
            return [(f, kind, "range:" + ",".join(bounds[f]) if bounds[f] else "Mongo query") for f in sorted(body)]
    return [(k, "unknown", "Mongo query") for k, v in sorted(c.items()) if isinstance(v, dict) and len(v) == 1 and next(iter(v)) in ("query", "value", "match")]


def elastic_by_hand(node):
    if isinstance(node, dict) and "bool" in node:
        out = []
        for part in ("must", "should", "filter", "must_not"):
            below = node["bool"].get(part) or [] if isinstance(node["bool"], dict) else []
            for c in below if isinstance(below, list) else [below] if isinstance(below, dict) else []:
                out += elastic_by_hand(c)
        return out
    return clause_by_hand(node)


def random_node(rng, depth):
    if depth and rng.random() < 0.6:
        parts = rng.sample(["must", "should", "filter", "must_not"], rng.randrange(5))
        return {"bool": {p: random_node(rng, depth - 1) if rng.random() < 0.3 else [random_node(rng, depth - 1) for _ in range(rng.randrange(4))] for p in parts}}
    field = rng.choice("abc")
    return rng.choice([
        {rng.choice(KINDS): {field: "v", "z": "w"}}, {rng.choice(KINDS): "plain"}, {"range": {field: {"lt": 3, "from": "x", "none": 1}}}, {"exists": {"field": field}},
        {"exists": {"field": "", "name": "n"}}, {field: {"query": 1}}, {field: {"query": 1, "b": 2}}, {field: 1}, {}, 5, None, [], "t", {"bool": 3}, {"bool": {"must": None}},
    ])


def test_elastic_fields_against_recursion(spark):
    rng = random.Random(3)
    nodes = [random_node(rng, 5) for _ in range(300)]
    texts = [json.dumps({"query": n} if k % 2 else n) for k, n in enumerate(nodes)]
    wanted = {k: elastic_by_hand(n) for k, n in enumerate(nodes)}
    df = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, ""), (1002, "{bad")], "k int, q string")
    got = {}
    for r in nosql.elastic_lineage(df, "q", "k").orderBy("k", "ordinal").collect():
        assert r["ordinal"] == len(got.setdefault(r["k"], []))
        got[r["k"]].append((r["columnName"], r["clause"], r["remark"]))
    assert got == {k: rows for k, rows in wanted.items() if rows}
    assert sum(map(len, got.values())) > 300


def test_elastic_order_and_parts(spark):
    q = json.dumps({"bool": {"must_not": [{"wildcard": {"b": "x*"}}, {"c": {"query": 1}}, 5], "must": {"term": {"a": 1}}}})
    rows = nosql.elastic_lineage(spark.createDataFrame([(q,)], "q string"), "q").orderBy("ordinal").collect()
    assert [(r["columnName"], r["clause"]) for r in rows] == [("a", "term"), ("b", "wildcard"), ("c", "unknown")]


def walk_by_hand(node, name="", classname=""):
    if isinstance(node, dict):
        name, classname = node.get("name") or name, node.get("classname") or classname
        if "view_name" in node and "sql_query" in node:
            yield name, classname, node["view_name"] or "", node["sql_query"] or ""
        for v in node.values():
            yield from walk_by_hand(v, name, classname)
    elif isinstance(node, list):
        for v in node:
            yield from walk_by_hand(v, name, classname)


def random_payload(rng, depth):
    if not depth:
        return rng.choice(["s", None, {}, [], True])
    if rng.random() < 0.3:
        return [random_payload(rng, depth - 1) for _ in range(rng.randrange(4))]
    names = rng.sample(["name", "classname", "view_name", "sql_query", "x", "y"], rng.randrange(7))
    return {n: random_payload(rng, depth - 1) if n in "xy" else rng.choice(["", None, "p", "q", "r"]) for n in names}


def test_walk_against_recursion(spark):
    rng = random.Random(5)
    payloads = [random_payload(rng, 6) for _ in range(300)]
    df = spark.createDataFrame([(json.dumps(p),) for p in payloads] + [(None,), ("",), ("{bad",)], "payload string")
    got = {tuple(r) for r in metadata.walk(df).collect()}
    assert got == {row for p in payloads for row in walk_by_hand(p)} and len(got) > 30


def test_deep_and_long_payloads(spark):
    """200 levels, 20,000 queries side by side, and a text of brackets that hold nothing."""
    inner = json.dumps({"view_name": "v", "sql_query": "q"})
    deep = '[{"a":' * 100 + inner + "}]" * 100
    wide = json.dumps([{"view_name": str(k), "sql_query": "q", "name": "n"} for k in range(20_000)])
    df = spark.createDataFrame([(deep,), (wide,), (json.dumps({"name": "[" * 100_000}),)], "payload string")
    assert metadata.walk(df).count() == 20_001
    assert "Python" not in metadata.walk(df)._jdf.queryExecution().toString()


def test_part_walks_are_dealt_to_all_tasks(spark, tmp_path):
    """A small file is one split, while walking a row takes long: the rows are dealt before."""
    from tracewell.queries import QUERIES

    row = "id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, 3 AS p_size"
    spark.range(40).selectExpr(*row.split(", ")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("meta_json_walk", "meta_json_walk_deep", "nosql_elastic_kinds"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Repartition 4, true"), name
    assert QUERIES["nosql_elastic_kinds"](spark, str(tmp_path)).rdd.getNumPartitions() == 4
