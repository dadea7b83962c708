"""Blocks by chunks and by micro-batches against reading line by line."""

import random
import re
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators.logs import block_count, error_blocks, root_causes
from tracewell.operators.scan import prefix_scan
from tracewell.streaming.blocks import BlockProcessor, OpenBlock, append_blocks

LINES = ["", " ", "\t", "noise", "ERROR a", "x Exception y", "Caused by: bad thing", "Caused by:", "Caused by:  ", "  at z", "Caused by:x Caused by:", "Caused by: Caused by: twice", "q" * 900]


def logs(seed: int, files: int, n: int) -> dict[str, list[tuple[int, str]]]:
    rng = random.Random(seed)
    found = {f"f{k}": [(i * rng.choice([1, 1, 3]) + i * 3, rng.choice(LINES)) for i in range(rng.randint(0, n))] for k in range(files)}
    return {f: sorted(dict(lines).items()) for f, lines in found.items()} | {"quiet": [(0, "no block")], "long": [(0, "ERROR"), *((i, "q" * 90) for i in range(1, 200)), (500, "Caused by: late")]}


def by_line(lines):
    blocks, inside = [], False
    for n, line in lines:
        if re.search("Exception|ERROR|Caused by", line):
            blocks.append([])
            inside = True
        if inside:
            blocks[-1].append((n, line))
        if not line.strip(" "):
            inside = False
    return blocks


def cause(block):
    return (re.findall(r"Caused by:\s+([^\n]*)", "\n".join(line for _, line in block), flags=re.ASCII) or ["NO ROOT CAUSE FOUND"])[-1]


@pytest.fixture(scope="module")
def many():
    return logs(3, 12, 120)


@pytest.mark.parametrize("chunk", [1, 4, 17, 65_536])
def test_chunks_of_any_width(spark, many, chunk):
    rows = [(f, n, line) for f, lines in many.items() for n, line in lines]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "file string, line_no long, line string").repartition(5)
    found = error_blocks(df, chunk=chunk)
    want = {(f, k): b for f, lines in many.items() for k, b in enumerate(by_line(lines), 1)}
    assert sorted(map(tuple, found.collect())) == sorted((f, k, n, line) for (f, k), b in want.items() for n, line in b)
    got = {(r["file"], r["block_id"]): (r["root_cause"], r["trace"]) for r in root_causes(found, most=700, chunk=chunk).collect()}
    assert got == {k: (cause(b), "\n".join(line for _, line in b)[:700]) for k, b in want.items()}
    assert dict(map(tuple, block_count(found).collect())) == {f: max(k for g, k in want if g == f) for f in {f for f, _ in want}}


@pytest.mark.parametrize("most", [*range(4, 16), 30])
def test_trace_ends_beside_a_line_break(spark, most):
    block = ["ERROR ab", "", "cdé", "f"]
    blocks = spark.createDataFrame([("f", 1, n, line) for n, line in enumerate(block)], "file string, block_id long, line_no long, line string")
    assert [r["trace"] for r in root_causes(blocks, most=most).collect()] == ["\n".join(block)[:most]]


def test_no_window_over_a_file(spark):
    df = spark.createDataFrame([("f", 1, "ERROR")], "file string, line_no long, line string")
    plan = error_blocks(df)._jdf.queryExecution().analyzed().toString()
    lines_windows = [w for w in re.findall(r"windowspecdefinition\(([^)]*)", plan) if "_n#" in w.split("ASC")[0]]
    assert lines_windows and all("_chunk#" in w for w in lines_windows)


def test_odd_lines_and_names(spark):
    rows = [(None, 1, "ERROR a"), (None, 2, "b"), ("f", None, "ERROR lost"), ("f", 1, None), ("f", 2, "ERROR"), ("f", 3, None), ("f", -5, "Exception")]
    df = spark.createDataFrame(rows, "_f string, _n int, _t string")
    got = sorted(map(tuple, error_blocks(df, "_f", "_n", "_t").collect()), key=str)
    assert got == sorted([(None, 1, 1, "ERROR a"), (None, 1, 2, "b"), ("f", 1, -5, "Exception"), ("f", 1, 1, None), ("f", 2, 2, "ERROR"), ("f", 2, 3, None)], key=str)
    assert root_causes(error_blocks(df.where("false"), "_f", "_n", "_t"), "_f", "_n", "_t").collect() == []


def test_scan_of_sums_maxima_and_last_values(spark):
    df = spark.createDataFrame([("g", i, i % 3 or None) for i in range(20)], "g string, i int, v int")
    got = prefix_scan(df, ["g"], "i", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, chunk=4)
    want, seen = [], []
    for i in range(20):
        known = [v for v in seen if v]
        want.append((i, sum(known), max(known, default=None), known[-1] if known else None))
        seen.append(i % 3 or None)
    assert sorted((r["i"], r["s"], r["m"], r["l"]) for r in got.collect()) == want


def test_stream_in_batches(spark, many, tmp_path):
    rows = [(f, n, line) for f, lines in many.items() for n, line in lines]
    edges = [-1, 40, 41, 200, 10**9]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = [r for r in rows if low < r[1] <= high] + ([(f, 10**9 + 1, None) for f in many] if high == 10**9 else [r for r in rows if r[1] == low])
        random.Random(low).shuffle(part)
        spark.createDataFrame(part, "file string, line_no long, line string").coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("file string, line_no long, line string").parquet(f"{tmp_path}/in")
        append_blocks(stream, f"{tmp_path}/out", f"{tmp_path}/state", most=700)
    got = {(r["file"], r["block_id"]): (r["first_line"], r["last_line"], r["n_lines"], r["root_cause"], r["trace"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(f, k): (b[0][0], b[-1][0], len(b), cause(b), "\n".join(line for _, line in b)[:700]) for f, lines in many.items() for k, b in enumerate(by_line(lines), 1)}
    assert got == want


def test_a_block_closed_by_waiting():
    block = OpenBlock()
    assert list(block.feed(1, "ERROR a", 50)) == [] and list(block.close()) == [(1, 1, 1, 1, "NO ROOT CAUSE FOUND", "ERROR a")]
    assert list(block.feed(2, "rest", 50)) == [] and list(block.close()) == []
    assert list(block.feed(2, "ERROR again", 50)) == [] and list(block.feed(3, "ERROR b", 50)) == [] and list(block.close())[0][0] == 2


class Kept:
    """A list state and the timers of one key, in memory."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], 0

    def getListState(self, *_):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def test_one_call_for_all_files_of_a_part():
    kept = Kept()
    processor = BlockProcessor("file", "bigint", 50, 10)
    processor.init(kept)

    def feed(at, *rows):
        new = pd.DataFrame([(f or 0, f is not None, n, line) for f, n, line in rows], columns=["name", "named", "line_no", "line"])
        return [tuple(r) for d in processor.handleInputRows((0,), iter([new]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: at)) for r in d.itertuples(index=False)]

    def expire(at):
        kept.timers.remove(at)
        return [tuple(r) for d in processor.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda: at)) for r in d.itertuples(index=False)]

    many = [(f, n, line) for f in range(1, 500) for n, line in ((2, "rest"), (1, "ERROR"))]
    assert feed(0, *many) == [] and kept.calls == 1 and len(kept.rows) == 499 and kept.timers == [10_000]
    assert feed(4_000, (1, 3, ""), (2, 3, "more"), (None, 1, "ERROR"), (0, 1, "Exception")) == [(1, 1, 1, 3, 3, "NO ROOT CAUSE FOUND", "ERROR\nrest\n")]
    assert kept.calls == 3 and kept.timers == [10_000]
    assert [r[0] for r in expire(10_000)] == list(range(3, 500)) and kept.timers == [14_000]
    assert sorted(expire(14_000), key=str) == sorted([(2, 1, 1, 3, 3, "NO ROOT CAUSE FOUND", "ERROR\nrest\nmore"), (None, 1, 1, 1, 1, "NO ROOT CAUSE FOUND", "ERROR"), (0, 1, 1, 1, 1, "NO ROOT CAUSE FOUND", "Exception")], key=str)
    assert kept.timers == [] and feed(20_000, (3, 3, "ERROR"), (3, 4, None))[0][:2] == (3, 2) and kept.timers == []


def test_stream_of_files_dealt_to_few_parts(spark, tmp_path):
    big = (1 << 53) + 1
    batches = [[(big, 1, "ERROR"), (big + 1, 1, "ERROR"), (None, 1, "ERROR"), (0, 1, "ERROR"), (0, None, "lost")], [(big, 2, "x"), (None, 2, ""), (big, None, None), (big + 1, 2, "Exception"), (big + 1, 3, None), (0, None, None)]]
    for rows in batches:
        spark.createDataFrame(rows, "_f long, line_no long, line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        append_blocks(spark.readStream.schema("_f long, line_no long, line string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", file="_f", parts=1)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, found.select("_f", "block_id", "first_line", "last_line", "trace").collect()), key=str) == sorted(
        [(big, 1, 1, 2, "ERROR\nx"), (big + 1, 1, 1, 1, "ERROR"), (big + 1, 2, 2, 2, "Exception"), (None, 1, 1, 2, "ERROR\n"), (0, 1, 1, 1, "ERROR")], key=str)
