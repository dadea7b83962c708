import base64
import difflib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import python as P
from tracewell.functions import text as T
from tracewell.operators import dq, logs, match, metadata, nosql, recon
from tracewell.sources import files, http, sinks
from tracewell.streaming import streams


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


# -- data quality

PEOPLE = [(1, "Al", 30), (2, "Bo", None), (3, "Al", 30), (4, None, 45), (5, "Cy", 70), (6, "Di", 17), (7, "Al", 30)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id int, name string, age int")


def test_checks(people):
    assert {tuple(r) for r in dq.null_counts(people).collect()} == {("name", 1), ("age", 1)}
    assert dq.duplicates(people).count() == 0
    assert {r["id"] for r in dq.duplicates(people, ["id"], ["name", "age"]).collect()} == {3, 7}
    assert {r["id"] for r in dq.out_of_range(people, "age", 18, 60).collect()} == {5, 6}
    assert {r["id"] for r in dq.pattern_violations(people, "name", "A").collect()} == {2, 4, 5, 6}
    assert {r["id"] for r in dq.domain_violations(people, "name", ["Al", "Bo"]).collect()} == {4, 5, 6}


def test_rules_and_missing_columns(people):
    rules = files.rules_from_yaml("columns:\n  email: {pattern: x}\n  age: {min: 18, max: 60, required: true}\n  department: {allowed_values: [a]}\n  salary: {min: 1}\n")
    found = dq.run_checks(people, rules)
    assert set(found) == {"nulls", "duplicates", "range:age", "required:age", "range:salary"}
    assert found["range:salary"].columns == ["error"] and found["required:age"].count() == 1


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (99.0,)], "age double")
    assert dq.out_of_range(df, "age", 0, 10).count() == 1 and dq.null_counts(df).first()["nulls"] == 2


# -- reconciliation


def test_recon_scenarios(spark):
    """The six reasons of the design notes, an unmatched id, and an equal version that is not the latest."""
    suffix = "_202501010"
    cases = [
        ("u1", 2, "r1b", [("r1a", 1, "ACK", 2), ("r1b", 2, "ACK", 1)], "value_mismatch_reghub_error"),
        ("u2", 3, "r2a", [("r2a", 2, "ACK", 2), ("r2b", 3, "ACK", 1)], "false_break_timing_issue"),
        ("u3", 3, "r3a", [("r3a", 2, "ACK", 2), ("r3b", 3, "NACK", 1)], "pending_nack_resolution"),
        ("u4", 3, "r4a", [("r4a", 2, "ACK", 2), ("r4b", 3, "NON_REPORTABLE", 1)], "non_reportable_review"),
        ("u5", 3, "r5a", [("r5a", 2, "ACK", 1)], "missing_from_source"),
        ("u6", 1, "r6a", [("r6a", 2, "ACK", 1)], "olympus_data_issue"),
        ("u7", 1, "none", [("r7a", 2, "ACK", 1)], "cannot_be_determined"),
        ("u8", 1, "r8a", [("r8a", 1, "ACK", 2), ("r8b", 2, "ACK", 1)], "cannot_be_determined"),
    ]
    positions = spark.createDataFrame([(u, v, "t", m + suffix, "Open", "9") for u, v, m, *_ in cases] + [("u9", 1, "t", "x" + suffix, "closed", "9")], "uitid string, version int, break_type string, tsr_msg_id string, break_status string, recon_id string")
    submissions = spark.createDataFrame([(i, u, v, s, k) for u, _, _, subs, _ in cases for i, v, s, k in subs], "reghub_id string, keys_uitid string, version int, state_status string, reg_ranking int")
    got = {r["uitid"]: r["field_control_break_reason"] for r in recon.classify(positions, submissions, "9").collect()}
    assert got == {u: reason for u, *_, reason in cases}


# -- functions


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcXYZ_ 019", max_size=12), st.text(alphabet="abcXYZ_ 019", max_size=12))
def test_ratio_is_the_stdlib_ratio(a, b):
    assert P.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio() * 100


def test_tokens_and_overlap(spark):
    tokens = lambda s: set(one(spark, T.token_array(F.lit(s))))
    assert tokens("trade_status2_sk 77") == {"TRADE", "STATUS", "SK"} and tokens("") == set()
    assert one(spark, T.overlap(F.lit("trade_id"), F.lit("TRADE_KEY"))) and not one(spark, T.overlap(F.lit("a_id"), F.lit("b_id")))
    assert one(spark, T.norm(F.lit(" a_b c "))) == "ABC" and one(spark, T.norm(F.lit(None).cast("string"))) == ""


def test_percent_rounds_like_python(spark):
    df = spark.createDataFrame([(66.25,), (87.5,), (99.95,)], "x double").select(P.percent_udf("x").alias("p"))
    assert [r["p"] for r in df.collect()] == ["66.2%", "87.5%", f"{99.95:.1f}%"]


def test_base64(spark):
    for s in ("select 1", "ünï", "a", "ab??>>"):
        for coded in (base64.b64encode(s.encode()).decode(), base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")):
            assert one(spark, T.b64_decode(F.lit(coded))) == s
    assert one(spark, T.b64_or_raw(F.lit("select * from t"))) == "select * from t" and one(spark, T.b64_strict(F.lit("YQ=="))) == ""
    assert P.decode_lenient("c2VsZWN0IDE") == "select 1" and P.decode_lenient(None) == ""


def test_statements_and_columns():
    assert P.statements("a 'x;y' -- c;\n; B /* ; */;;") == ["a 'x;y'", "b"]
    assert P.split_columns("a, f(b, ','), \"c,d\" ,") == ["a", "f(b, ',')", '"c,d"']


def test_routes_and_safety(spark):
    kinds = [one(spark, T.query_type(F.lit(s))) for s in ('{"a":1}', "[1]", "select map(a,b)", "select a")]
    assert kinds == ["mongo", "elastic", "map", "sql"]
    assert one(spark, T.engine(F.lit('{"query": {"bool": 1}}'))) == "elastic" and one(spark, T.engine(F.lit("db.x.find({a: {$gt: 1}})"))) == "mongo"
    assert not one(spark, T.safe_sql(F.lit("drop table x"))) and one(spark, T.safe_sql(F.lit("select dropped")))


def test_dialect_rewrites(spark):
    say = lambda s: one(spark, T.to_spark_sql(F.lit(s)))
    assert say("select group_concat(a, ';') from t") == "select concat_ws(';', collect_list(a)) from t"
    assert say("select appx_median(x), DATEADD(day, 3, d) from t") == "select percentile_approx(x, 0.5), DATE_ADD(d, 3) from t"
    assert say("x #ANY_NAME# interval 2 days") == "x 20231101 INTERVAL 2 days".replace("days", "day")


# -- matching


def test_match_cases(spark):
    fields = spark.createDataFrame([(1, "trade_status_sk", "f1"), (2, "symbol", "f2"), (3, "firm_code", "f3"), (4, "price_amount_total_value", "f4"), (5, "", "f5")], "field_no int, mapperColumn string, mapperFactField string")
    rows = spark.createDataFrame([
        (1, "db", "t", "TRADE_STATUS", "trade_status_sk"), (2, "db", "t", "symbol", ""), (3, "gfolyreg_work", "t", "firm_code", ""), (4, "", "t", "firm", ""), (5, "db", "t", "*", ""),
        (6, "db", "t", "status", "trade_x"), (7, "db", "t", "q_value_zzzzzzzzzzzzzzzzzzzzzzzzzzzz", ""),
    ], "row_no long, db string, table string, column string, alias string")
    got = [r.asDict() for r in match.match_columns(fields, rows, "k", "REG").collect()]
    of = lambda n: {(r["matchType"], r["columnName"], r["matchPercentage"], r["matchedOn"]) for r in got if r["field_no"] == n}
    assert ("exact", "TRADE_STATUS", "100.0%", "alias") in of(1) and {x[0] for x in of(1)} <= {"exact", "fuzzy"}
    assert of(2) == {("exact", "symbol", "100.0%", "columnName")}
    assert of(3) == {("no_match", "", "0.0%", "")}
    assert {x[0] for x in of(4)} == {"weak"} and not of(5)
    assert match.summary(spark.createDataFrame(got)).first().asDict() == {"total": len(got), **{k: sum(r["matchType"] == k for r in got) for k in ("exact", "fuzzy", "weak", "no_match")}}


def test_fact_and_mapper_payloads(spark):
    payload = {"totalRecords": 1, "factContainers": [{"windata": [{"a1": "d", "a2": "t", "a3": "x", "a4": "c", "a5": "al", "a6": "f", "a7": "v", "lxl": ["r"]}], "winkeys": {"olympusApplication": "app"}}]}
    df = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    r = match.flatten_facts(df).first()
    assert (r["db"], r["alias"], r["file"], r["actions"], r["application"]) == ("d", "al", "f", ["r"], "app")
    assert match.flatten_facts(df, compat=True).first()["db"] == "x"
    m = {"name": "m", "value": {"table_columns": [{"column_name": "a", "field": "f", "column_type": "int"}, {"field": "g"}]}}
    assert [tuple(r) for r in match.mapper_fields(spark.createDataFrame([(json.dumps(m),)], "payload string")).collect()] == [(0, "a", "f"), (1, "", "g")]


# -- metadata


def test_metadata_shapes(spark):
    q = lambda s: {"view_name": "v" + s, "sql_query": base64.b64encode(f"select {s} from t".encode()).decode()}
    rec = {"name": "n", "regulation": "r", "value": {"classname": "c", "create_query": [q("a"), q("b")], "select_query": q("s")}}
    texts = [json.dumps({"metadataList": [rec]}), json.dumps([rec, rec]), json.dumps(rec), "not json", None]
    flat = metadata.flatten(metadata.records(spark.createDataFrame([(t,) for t in texts], "payload string")))
    assert flat.count() == 12 and {r["sql"] for r in flat.collect()} == {"select a from t", "select b from t", "select s from t"}
    walked = metadata.walk(spark.createDataFrame([(json.dumps({"x": [{"name": "n", "deep": {"classname": "c", "q": q("z")}}]}),), ("{bad",), (None,)], "payload string"))
    assert [(r["name"], r["classname"], r["view_name"]) for r in walked.where("view_name IS NOT NULL").collect()] == [("n", "c", "vz")]


def test_diff_ignores_key_order_and_keeps_the_last(spark):
    a = spark.createDataFrame([("x", '{"a":1,"b":2}', 1), ("x", '{"b":2,"a":1}', 2), ("y", "1", 1), ("", "0", 1), ("n", "1", 1)], "k string, v string, o int")
    b = spark.createDataFrame([("x", '{"a": 1, "b": 2}', 1), ("y", "2", 1), ("p", "1", 1)], "k string, v string, o int")
    got = {tuple(r) for r in metadata.diff(metadata.snapshot(a, "k", "v", ["o"]), metadata.snapshot(b, "k", "v", ["o"])).collect()}
    assert got == {("y", "diff"), ("n", "new"), ("p", "purged")}


def test_upsert_keeps_user_status(spark):
    old = spark.createDataFrame([("1", "approved"), ("3", "old")], "id string, status string")
    new = spark.createDataFrame([("1", "new"), ("2", "new")], "id string, status string")
    assert {tuple(r) for r in metadata.upsert(old, new).collect()} == {("1", "approved"), ("2", "new"), ("3", "old")}


# -- logs, payloads, sources, sinks, streams


def test_log_blocks(spark, tmp_path):
    (tmp_path / "a.log").write_text("ok\nERROR one\n at x\n\nnoise\nException two\nCaused by: y z\n at q\n")
    blocks = logs.error_blocks(files.read_log(spark, str(tmp_path / "a.log")))
    got = {r["block_id"]: (r["root_cause"], r["trace"]) for r in logs.root_causes(blocks).collect()}
    assert got[1] == ("NO ROOT CAUSE FOUND", "ERROR one\n at x\n") and got[2][0] == "NO ROOT CAUSE FOUND" and got[3][0] == "y z"
    assert logs.block_count(blocks).first()["n_blocks"] == 3


def test_nosql_shapes():
    assert list(nosql.mongo_rows({"op": "find", "collection": "c", "projection": {"a": 1, "b": True, "d": 0}})) == [("c", "a", "", "Mongo Query"), ("c", "b", "", "Mongo Query"), ("c", "d", "d", "Mongo Query")]
    assert list(nosql.mongo_rows({"op": "other"})) == []


def test_http_guard_and_retries():
    for bad in ("http://x.org", "https://localhost", "https://10.1.2.3/a", "https://[::1]/", "ftp://x.org", "https://"):
        with pytest.raises(http.UnsafeUrl):
            http.check_url(bad)
    with pytest.raises(http.UnsafeUrl):
        http.check_url("https://x.org", resolve=lambda h: ["192.168.0.1"])
    assert http.check_url("https://a.x.org/p", ["x.org"]) == "https://a.x.org/p"
    answers, waits = iter([(503, ""), (429, ""), (200, "ok")]), []
    assert http.fetch("https://x", send=lambda *a: next(answers), sleep=waits.append) == (200, "ok") and waits == [1.0, 2.0]
    assert http.fetch("https://x", send=lambda *a: (404, "no"), sleep=waits.append) == (404, "no")

    def fail(error):
        def send(*a):
            raise error
        return send

    assert [http.fetch("https://x", retries=0, send=fail(e))[0] for e in (TimeoutError(), ConnectionError(), KeyError())] == [504, 502, 500]


def test_files_and_sinks(spark, tmp_path, people):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "one.sql").write_text("select 1")
    (tmp_path / "q" / "g.json").write_text("{}")
    (tmp_path / "q" / "b.json").write_text("{bad")
    (tmp_path / "rules.yaml").write_text("columns: {age: {min: 1}}")
    assert [tuple(r) for r in files.read_sql_files(spark, [f"{tmp_path}/q/one.sql", f"{tmp_path}/q/none.sql"]).collect()] == [("ONE", "select 1")]
    assert {(r["payload"], r["error"]) for r in files.read_json_texts(spark, f"{tmp_path}/q").collect()} == {("{}", None), (None, "invalid JSON")}
    assert files.read_rules(spark, f"{tmp_path}/rules.yaml")["columns"]["age"]["min"] == 1
    with pytest.raises(ValueError):
        files.read_uploaded_json(spark, "x.txt")
    d = files.sql_dictionary(spark, {"A": "select 1", "B": "select 2"}, {"A": {"view_name": "va", "regulation": "r"}})
    assert {(r["query_key"], r["view_name"], r["regulation"]) for r in d.collect()} == {("A", "va", "r"), ("B", "B", "")}
    sinks.write_csv(people, f"{tmp_path}/out", single_file=True)
    assert files.read_csv(spark, f"{tmp_path}/out").count() == 7
    with pytest.raises(ValueError):
        sinks.write_csv(people.limit(0), f"{tmp_path}/none")
    sinks.write_report(dq.run_checks(people, {}), f"{tmp_path}/report")
    assert spark.read.parquet(f"{tmp_path}/report/nulls").count() == 2
    assert json.loads(sinks.json_envelope(people).first()["body"])["total_records"] == 7
    assert sinks.envelope(people).count() == 7


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(20).selectExpr("cast(id AS int) AS age", "timestamp_seconds(id * 60) AS ts").write.parquet(src)
    stream = lambda: spark.readStream.schema("age int, ts timestamp").parquet(src)
    seen = {}
    streams.check_stream(stream(), {"columns": {"age": {"min": 5, "max": 9}}}, lambda n, df, k: seen.__setitem__(n, df.count()), str(tmp_path / "c1")).awaitTermination()
    assert seen["range:age"] == 15
    counts = streams.violation_counts(stream(), F.col("age") > 9)
    q = counts.writeStream.format("memory").queryName("violations").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("violations").agg(F.sum("n"), F.sum("violations")).first()[:] == (20, 10)
