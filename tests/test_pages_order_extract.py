"""The HTTP data source against a local server, sorted tables, extracts from rules."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tracewell.operators.extract import Extract, Rule, run_extract
from tracewell.sources import http_pages
from tracewell.sources.ordered import misplaced, read_ordered, write_ordered


#: A transport to the local server that stands in for the host of ``url``, whose port is in the headers.
SEND = """
import urllib.error
import urllib.request


def send(url, method, body, headers, timeout):
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{headers['X-Port']}/{url.rpartition('/')[2]}", timeout=timeout) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()
"""


@pytest.fixture
def server():
    asked = {}

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            n = int(self.path[1:])
            asked[n] = asked.get(n, 0) + 1
            code = 404 if n == 5 else 503 if n == 3 and asked[n] == 1 or n == 8 else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(f"page {n}".encode())

        def log_message(self, *_):
            pass

    running = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield running.server_port, asked
    running.shutdown()


def test_pages_of_a_server(spark, server, tmp_path):
    port, asked = server
    (tmp_path / "send_to_local_server.py").write_text(SEND)
    spark.sparkContext.addPyFile(str(tmp_path / "send_to_local_server.py"))
    spark.dataSource.register(http_pages.HttpPages)
    read = spark.read.format("http_pages").options(url="https://pages.example.org/{n}", first=0, last=9, per_partition=4, retries=1, backoff=0, headers=f'{{"X-Port": "{port}"}}', transport="send_to_local_server:send")
    frame = read.load()
    assert frame.rdd.getNumPartitions() == 3
    rows = {r["request_no"]: r for r in frame.collect()}
    refused = read.option("allowed", "other.example.org").load().collect()
    assert sorted(rows) == list(range(10)) and rows[2]["body"] == "page 2" and rows[2]["error"] is None
    assert (rows[5]["status"], rows[5]["error"], rows[5]["body"]) == (404, "page 5", None)
    assert rows[3]["status"] == 200 and rows[8]["status"] == 503
    assert {r["status"] for r in refused} == {403}


def test_no_requests_and_wrong_options(spark):
    spark.dataSource.register(http_pages.HttpPages)
    assert spark.read.format("http_pages").options(url="https://a/{n}", first=3, last=2).load().collect() == []
    with pytest.raises(ValueError):
        http_pages.PageReader({"url": "https://a/{n}", "last": "1", "per_partition": "0"})


def test_order_is_kept_and_faults_are_found(spark, tmp_path):
    rows = [(i * 7919 % 1000, None if i % 50 == 0 else f"n{i % 37}") for i in range(1000)]
    write_ordered(spark.createDataFrame(rows, "k int, name string").repartition(6), f"{tmp_path}/a", ["name", "k"])
    read = read_ordered(spark, f"{tmp_path}/a")
    got = [(r["name"], r["k"]) for r in sorted(read.collect(), key=lambda r: r["order_no"])]
    assert got == sorted(((n, k) for k, n in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert misplaced(read, ["name", "k"], chunk=64).count() == 0
    assert [r["order_no"] for r in misplaced(read.withColumn("k", F.when(F.col("order_no") == 500, -1).otherwise(F.col("k"))).where("name IS NOT NULL"), ["k"], chunk=64).where("order_no = 500").collect()] == [500]
    write_ordered(spark.createDataFrame([], "k int"), f"{tmp_path}/b", ["k"])
    assert read_ordered(spark, f"{tmp_path}/b").collect() == []
    with pytest.raises(ValueError):
        write_ordered(spark.createDataFrame([], "_range int"), f"{tmp_path}/c", ["_range"])


def test_rules_of_an_extract(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), (None, 3, "y"), ("a", None, "z")], "s string, n int, t string")
    rules = [
        Rule("same", column="t", default="none"), Rule("joined", parts=["=<", "s", "=>", "n"], default="?"), Rule("seven", value=7, kind="long"), Rule("big", column="t", upper=True, cut=(1, 1)),
        Rule("arm", arms=[("s", "a", "A"), ("s", None, "null"), ("n", 2, "two")], default="other"),
    ]
    got = sorted(map(tuple, run_extract(df, Extract(rules)).collect()), key=str)
    want = [("none", "<a>1", 7, None, "A"), ("x", "<b>2", 7, "X", "two"), ("y", "<?>3", 7, "Y", "null"), ("z", "<a>?", 7, "Z", "A")]
    assert got == sorted(want, key=str)
    assert run_extract(df, Extract(rules[:1], among={"n": [2, 3]}, present=["s"])).collect()[0][0] == "x"


@pytest.mark.parametrize("wrong", [Extract([Rule("a", column="no")]), Extract([Rule("a", column="s"), Rule("A", value=1)]), Extract([Rule("a", column="s", value=1)]), Extract([Rule("a", column="s")], among={"n": []})])
def test_wrong_rules_are_refused(spark, wrong):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    with pytest.raises(ValueError):
        run_extract(df, wrong)
