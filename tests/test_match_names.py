"""Matching by distinct names against comparing every field with every row."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions.python import ratio
from tracewell.operators import match

STOP = {"ID", "IDENTIFIER", "CODE", "KEY", "SK", "NO", "NUM"}


def tokens(name):
    import re

    spaced = re.sub(r"([A-Z]+)(\d+)", r"\1 \2", name.upper().replace("_", " "))
    return {t for t in spaced.split() if not t.isdigit()} - STOP


def norm(name):
    return name.upper().replace("_", "").replace(" ", "").strip()


def by_hand(fields, rows, threshold):
    out = []
    for number, mapper, fact in fields:
        if not mapper:
            continue
        found = []
        for row_no, db, _, column, alias in rows:
            first = alias if alias.strip() else column
            if not db or "staging" in db or first.strip() == "*":
                continue
            if tokens(mapper) & tokens(first):
                compared = first
            elif alias.strip() and column.strip() != "*" and tokens(mapper) & tokens(column):
                compared = column
            else:
                continue
            score = 100.0 if norm(mapper) == norm(compared) else min(ratio(norm(mapper), norm(compared)), 99.0)
            found.append((-score, -len(compared), row_no))
        strong = [f for f in found if -f[0] >= threshold]
        weak = [min(found)] if found and not strong and min(found)[0] < 0 else []
        out += [(number, r, "exact" if s == -100.0 else "fuzzy" if -s >= threshold else "weak", f"{-s:.1f}%") for s, _, r in strong + weak] or [(number, None, "no_match", "0.0%")]
    return sorted(out, key=str)


def names(seed):
    rng = random.Random(seed)
    parts = ["brand", "name", "type", "key", "size", "zone", "x1", "Q9", "no", "Straße", "😀a"]

    def name():
        return rng.choice(["_", " ", "_"]).join(rng.choice(parts) for _ in range(rng.randint(0, 4)))

    fields = [(i, name() or None, "f") for i in range(40)] + [(40, "all", "f"), (41, "all_brand", "f"), (41 + 1, "all_brand", "g")]
    rows = [(i, rng.choice(["db", "db", "", "staging_q"]), "t", "all" if i % 2 else name(), rng.choice(["", name(), "*", "  "])) for i in range(400)]
    rows += [(1000 + i, "db", "t", f"all_{name()}", "") for i in range(200)]
    return fields, rows


@pytest.mark.parametrize(("threshold", "hot"), [(40.0, 50_000), (70.0, 7), (95.0, 1)])
def test_against_every_pair(spark, monkeypatch, threshold, hot):
    """``all`` is a token of more than half of the names; with a small ``hot`` it is split."""
    fields, rows = names(int(threshold))
    f = spark.createDataFrame(fields, "field_no int, mapperColumn string, mapperFactField string")
    r = spark.createDataFrame(rows, "row_no int, db string, table string, column string, alias string")
    plain = match.name_pairs
    monkeypatch.setattr(match, "name_pairs", lambda a, b, compat=False: plain(a, b, compat, hot))
    numbered = r.withColumn("table", F.col("row_no").cast("string"))
    got = match.match_columns(f, numbered, "k", "R", threshold=threshold, staging="staging").collect()
    assert sorted(((x["field_no"], int(x["tableName"]) if x["tableName"] else None, x["matchType"], x["matchPercentage"]) for x in got), key=str) == by_hand(fields, rows, threshold)


def test_each_pair_of_names_once(spark):
    f = spark.createDataFrame([(1, "new york city"), (2, "new york city")], "field_no int, mapperColumn string")
    r = spark.createDataFrame([(i, "york_new", "city new") for i in range(50)], "row_no int, column string, alias string")
    assert match.name_pairs(f, r).count() == 1 and match.gate(f, r).count() == 100


def test_letters_bound_the_ratio(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("AABCÉ😀") for _ in range(rng.randint(0, 12))), "".join(rng.choice("AABCÉ😀") for _ in range(rng.randint(1, 12)))) for _ in range(200)]
    for r in match.most_ratio(spark.createDataFrame(pairs, "_a string, _b string")).collect():
        assert ratio(r["_a"], r["_b"]) <= r["_most"] + 1e-9


def test_names_are_compared_in_all_tasks(spark):
    """Pairs of few bytes are not left to one task, as each takes long to compare."""
    pairs = spark.range(2000).selectExpr("concat('A', id % 500) AS _a", "concat('B', id % 500) AS _b")
    rated = match._rated(match.most_ratio(pairs).where("_most >= 0"))
    assert rated.count() == 500
    assert len([n for n in rated.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]) == 4


def test_best_rows_are_chosen_per_name_first(spark):
    """A thousand rows of three names: the same best rows as by ranking all pairs, of which only n a name are made."""
    fields = spark.createDataFrame([(1, "brand_name", "f"), (2, "size", "g")], "field_no int, mapperColumn string, mapperFactField string")
    rows = spark.range(1000).selectExpr(
        "id AS row_no", "'db' AS db", "'t' AS table", "element_at(array('brand_name', 'brand_size', 'brand'), cast(id % 3 + 1 AS int)) AS column", "CASE WHEN id % 2 = 0 THEN 'size_x' WHEN id % 5 = 0 THEN '' END AS alias")
    want = match.top_n(match.scored(fields, rows), 4).select("field_no", "row_no", "compared", "rank").collect()
    assert sorted(match.best_matches(fields, rows, 4).select("field_no", "row_no", "compared", "rank").collect()) == sorted(want) and len(want) == 8
    assert match.first_rows(rows, 4).count() == 24
