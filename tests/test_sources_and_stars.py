"""Logs read in splits, stars followed through subqueries."""

from tracewell.plans.layers import layers_of, trace_of
from tracewell.sources import files


def test_log_lines_over_splits(spark, tmp_path):
    """Numbers are the places in the file however small the splits are; files are apart."""
    given = {"a.log": ["ERROR x", "", "Caused by: é", "y" * 300, ""] * 40, "b.log": ["one"], "c.log": ["", "", "last"]}
    for name, lines in given.items():
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "empty.log").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.read_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found: dict[str, dict[int, str]] = {}
    for r in rows:
        found.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line_no"]] = r["line"]
    assert len(rows) == sum(map(len, found.values()))
    # The last line of a.log is empty and has no line end, so it is no line.
    assert found == {"a.log": dict(enumerate(given["a.log"][:-1])), "b.log": {0: "one"}, "c.log": dict(enumerate(given["c.log"]))}


def test_log_line_ends(spark, tmp_path):
    (tmp_path / "w.log").write_bytes(b"one\r\ntwo\r\n\r\nthree\n")
    assert sorted((r["line_no"], r["line"]) for r in files.read_log(spark, str(tmp_path / "w.log")).collect()) == [(0, "one"), (1, "two"), (2, ""), (3, "three")]


def test_star_traced_through_ctes_and_unions():
    sql = "WITH c AS (SELECT a, b FROM d.t UNION ALL SELECT x.* FROM e.u x) SELECT * FROM c, f.g"
    assert [(db, t, c, o) for db, t, c, o, _ in trace_of(sql)] == [("d", "t", "a", "a"), ("d", "t", "b", "b"), ("e", "u", "*", "*"), ("f", "g", "*", "*")]


def test_star_of_itself_ends():
    rows = list(trace_of("WITH c AS (SELECT * FROM c) SELECT * FROM c"))
    assert rows[-1][4][-1] == "subquery_resolution_depth_exceeded"


def test_star_layers():
    inner = [r for r in layers_of("SELECT * FROM (SELECT a, max(b) AS m FROM d.t GROUP BY a) s") if r[0] == 3]
    assert [(r[3], r[4], r[5]) for r in inner] == [("s", "a", "a"), ("s", "m", "m")]
