"""Whitening against numpy over the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import whitening
from tracewell.llm.whitening import Summary, deviations, whiten

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def by_hand(rows, most=16):
    """{(vec_id, place among equal ids): (n, deviation, x)}, and what is common to all."""
    x = [(i, [int(np.floor(64.0 * c)) + 1_000_000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}))
    n, sums = len(fit), [sum(int(r[d]) for r in fit) for d in range(fit.shape[1])]
    centred = fit - fit.mean(axis=0)
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    e, vectors = e[:most], vectors[:, :most]
    return x, n, sums, e, vectors, np.trace(centred.T @ centred / n)


def check(spark, df, rows, most=16):
    got = whiten(df, most=most)
    assert got.columns == COLUMNS
    x, n, sums, e, vectors, trace = by_hand(rows, most)
    real = [k for k in range(len(e)) if e[k] > 1e-9 * trace]
    found = got.collect()
    assert len(found) == len(x) * len(real)
    by_component = {}
    for r in found:
        by_component.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-6
        assert abs(r["explained"] - e[r["component"] - 1] / trace) <= 1e-6 * e[r["component"] - 1] / trace
    dev = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in x)
    for k in real:
        part = by_component[k + 1]
        assert sorted((str(r["vec_id"]), r["deviation"]) for r in part) == dev
        want = sorted((str(i), float(np.dot(np.array([a - s / n for a, s in zip(v, sums, strict=True)]), vectors[:, k]) / np.sqrt(e[k]))) for i, v in x)
        close = [np.allclose([w for _, w in sorted((str(r["vec_id"]), sign * r["whitened"]) for r in part)], [w for _, w in want], atol=1e-6) for sign in (1, -1)]
        assert any(close)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    return [(i, [float(c) for c in rng.normal(size=20) * np.linspace(1, 5, 20) + 3]) for i in range(300)]


SCHEMA = "vec_id long, embedding array<float>, component string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1) for i, v in rows], SCHEMA)


def test_against_numpy(spark, vectors):
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in vectors]
    hot = [(1000 + i, rows[7][1]) for i in range(200)] + [(None, rows[8][1]), (5, rows[5][1])]
    check(spark, frame(spark, rows + hot).repartition(9), rows + hot)
    check(spark, frame(spark, rows).repartition(3), rows, most=3)


def test_what_is_left_out(spark, vectors):
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in vectors]
    bad = [(900, None), (901, []), (902, [None] * 20), (903, [float("nan")] * 20), (904, [float("inf")] + [0.0] * 19), (905, [1.0] * 3), (906, [1e30] + [0.0] * 19)]
    check(spark, frame(spark, bad + rows), rows)


def test_fewer_vectors_than_dimensions_and_constant_ones(spark, vectors):
    check(spark, frame(spark, vectors[:6]), [(i, [float(np.float32(c)) for c in v]) for i, v in vectors[:6]])
    for rows in ([], vectors[:1], [(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, None)]):
        got = whiten(frame(spark, rows))
        assert got.columns == COLUMNS and got.collect() == []
    assert whiten(frame(spark, []).withColumn("vec_id", F.lit("a"))).schema["vec_id"].dataType.simpleString() == "string"


def test_small_blocks_and_deep_trees(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 60)
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in vectors]
    check(spark, frame(spark, rows).repartition(11), rows)


def test_merging_keeps_every_dimension():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(90, 7)) * 100).astype(np.int64)
    parts = [Summary.of(x[a:b]) for a, b in ((0, 1), (1, 4), (4, 40), (40, 90))]
    whole = parts[0].merge(parts[1]).merge(parts[2].merge(parts[3]))
    centred = x - x.mean(axis=0)
    assert whole.n == 90 and whole.sums == x.sum(axis=0).tolist()
    assert np.allclose((whole.vt.T * whole.s**2) @ whole.vt, centred.T @ centred)


def test_deviations_past_64_bits():
    x = np.array([[1 << 40, -5], [3, 4]], np.int64)
    sums = [(1 << 40) + 3, -1]
    want = [sum((10**6 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    assert deviations(x, 10**6, sums) == [w if w < 1 << 63 else None for w in want]
