"""Collocations against counting by hand."""

import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm.collocations import mine_collocations


def by_hand(rows, least=30, longest=4, most=2000, absorb=(80, 100), scale=2_000_000):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= least}
        holder = Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    holder[p[i : i + k]] = max(holder[p[i : i + k]], a)
        found = []
        for p, a in frequent.items():
            if len(p) < 2 or absorb[1] * holder[p] >= absorb[0] * a and holder[p]:
                continue
            score, k = min((scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made(seed: int, n: int):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "hall", "é", "a b", "Ä", " ", "x"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(["new york city hall", "new york", "of the"] + words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!"]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und", "", "e\nn\x00"])))
    return rows + [(None, "en"), ("", None), (" \t ", "en"), ("one", "fr"), ("new york " * 5000, "en"), ("same same same", "en"), ("same same same", "en")]


@pytest.mark.parametrize(("least", "longest", "most"), [(5, 4, 2000), (3, 2, 7), (4, 3, 50), (6, 5, 2000)])
def test_against_counting_by_hand(spark, least, longest, most):
    rows = made(least, 150)
    docs = spark.createDataFrame([(i, *r, "z", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, path string, n long").repartition(5)
    assert rows_of(mine_collocations(docs, least=least, longest=longest, most=most)) == by_hand(rows, least, longest, most)


def test_small_shards_and_a_full_bitmap_change_nothing(spark, monkeypatch):
    import tracewell.llm.collocations as c

    monkeypatch.setattr(c, "SHARD", 300)
    monkeypatch.setattr(c, "PATHS", 7)
    monkeypatch.setattr(c, "RANGE", 50)
    monkeypatch.setattr(c, "HEADS", 40)
    rows = made(9, 120)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert rows_of(mine_collocations(docs, least=4, bits=64)) == by_hand(rows, 4)


def test_nothing_frequent_and_empty_tables(spark, empty):
    docs = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert rows_of(mine_collocations(docs)) == []
    assert rows_of(mine_collocations(docs.where("false"))) == []
    with pytest.raises(ValueError):
        mine_collocations(docs, longest=1)


def test_counts_past_64_bit_products(spark):
    """The score's products pass 64 bits with a scale of this size."""
    docs = spark.createDataFrame([("p q", "en")] * 40, "text string, lang string")
    got = rows_of(mine_collocations(docs, scale=400_000_000_000))
    assert got == by_hand([("p q", "en")] * 40, scale=400_000_000_000)


class Steps:
    """Takes the functions of a chain of steps instead of running them."""

    def __init__(self):
        self.run = []

    def mapInArrow(self, run, _):  # noqa: N802
        self.run.append(run)
        return self

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition  # noqa: N815


def test_blocks_are_cut_and_merged_a_few_mb_at_a_time(monkeypatch):
    """One batch of many blocks isn't held again as one batch of slices, nor is a range as one of nodes."""
    import pyarrow as pa

    import tracewell.llm.collocations as c

    monkeypatch.setattr(c, "range_bounds", lambda runs: [b"en\nw00500"])
    names = [b"en\nw%05d" % i for i in range(30_000)]
    blocks = [(names[k : k + 1000], k) for k in range(0, 30_000, 1000)] * 4
    size = lambda b: (b"".join(b), np.array([len(n) for n in b], "<i4").tobytes(), np.full(len(b), 10, "<i8").tobytes())
    rows = [(b[0], b[0], *size(b)) for b, _ in blocks]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(5)], names=["drawn", "head", "paths", "lengths", "counts"])
    steps = Steps()
    c.merged(steps, 30, False)
    cut, add = steps.run
    slices = list(cut(iter([batch])))
    assert len(slices) > 1 and max(s.nbytes for s in slices) < 1.5 * (1 << 20) and sum(s.num_rows for s in slices) == len(rows) + 4
    table = pa.Table.from_batches(slices).sort_by("range")
    found = [r for b in add(iter(table.to_batches())) for r in b.to_pylist()]
    assert sorted((r["path"], r["n"]) for r in found) == [(n[3:], 40) for n in names]


def test_ranges_are_even_where_shards_begin_alike(spark, monkeypatch):
    """Blocks of all shards begin with the same paths; ranges are still cut between them."""
    import tracewell.llm.collocations as c

    monkeypatch.setattr(c, "SHARD", 1)
    monkeypatch.setattr(c, "RANGE", 500)
    texts = spark.range(60, numPartitions=1).select(F.concat(F.lit("a "), F.concat_ws(" ", *[F.concat(F.lit(f"w{k:02d}"), F.col("id")) for k in range(100)])).cast("binary").alias("text"), F.lit("en").cast("binary").alias("lang"))
    bounds = c.range_bounds(c.counted(texts, (1, 1), None))
    paths = sorted(f"en\nw{k:02d}{i}".encode() for k in range(100) for i in range(60))
    held = np.bincount([bisect_right(bounds, p) for p in paths])
    assert len(bounds) > 6 and held.max() < 4 * 500


def test_odd_bytes_keep_paths_in_order(spark, monkeypatch):
    """Bytes below the blank part the order of paths from that of their words."""
    import tracewell.llm.collocations as c

    monkeypatch.setattr(c, "PATHS", 3)
    monkeypatch.setattr(c, "RANGE", 10)
    rng = random.Random(4)
    rows = [(" ".join(rng.choices(["a", "a\x01", "a\x1fb", "b", "\x00", "é", "B\x7f"], k=40)), rng.choice(["e", "e\x01", "e f", ""])) for _ in range(60)]
    for chosen in (rows, [(t.replace("\x01", "").replace("\x1f", "").replace("\x00", ""), "e") for t, _ in rows]):
        docs = spark.createDataFrame(chosen, "text string, lang string").repartition(3)
        assert rows_of(mine_collocations(docs, least=4)) == by_hand(chosen, 4)
        runs = c.counted(docs.select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("binary").alias("lang")), (1, 1), None).collect()
        blocks = [c.unpacked(r["paths"], r["lengths"]).to_pylist() for r in runs]
        assert all(b == sorted(b) for b in blocks) and all(r["drawn"] in b for r, b in zip(runs, blocks, strict=True))


def test_a_row_of_the_bitmap_is_made_in_one_task(spark, monkeypatch):
    """Tasks send hashes, not a bitmap row each, and the aggregate doesn't deal them again."""
    import tracewell.llm.collocations as c

    made_of = []
    bitmap_of = c.bitmap_of
    monkeypatch.setattr(c, "bitmap_of", lambda *a: made_of.append((a[0], bitmap_of(*a))) or made_of[-1][1])
    bits = 1 << 18
    paths = spark.range(3000, numPartitions=9).select(F.lit("en").cast("binary").alias("lang"), F.col("id").cast("string").cast("binary").alias("path"))
    known = c.likely(paths, bits).value
    hashes, rows = made_of[0]
    placed = hashes.select(F.spark_partition_id().alias("p"), F.floor(F.pmod("_h", F.lit(bits)) / 32768).alias("b")).distinct().collect()
    assert len({r["b"] for r in placed}) == len(placed) == 8
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortAggregate") == 2 and plan.count("Exchange hashpartitioning") == 1
    import pyarrow as pa

    assert known(pa.array([b"en\n%d" % i for i in range(3000)], pa.binary())).all() and not known(pa.array([b"xx\n%d" % i for i in range(3000)], pa.binary())).all()
