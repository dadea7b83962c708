"""Embedding whitening by hierarchical merging of singular value decompositions.

Each partition keeps the count and the exact sums of its vectors and, of the
centred rows, all singular values and right vectors.  Two such summaries merge
losslessly: the rows s * v of both and one row for the distance of their means,
sqrt(n1 * n2 / (n1 + n2)) * (mean1 - mean2), have the cross products of all
centred rows together, so their decomposition is that of the whole.  Summaries
are merged ``FAN`` at a time until one is left, a table of d rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Entries are kept as whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Summaries merged by one task, and values of a block of vectors worked on at once.
FAN, BLOCK = 8, 1 << 20
PART = "_part int, n long, sums binary, s binary, vt binary"
PART_ARROW = pa.schema([("_part", pa.int32()), ("n", pa.int64()), ("sums", pa.binary()), ("s", pa.binary()), ("vt", pa.binary())])
MOMENTS = "_part int, n long, mean binary, m2 binary"
MOMENTS_ARROW = pa.schema([("_part", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("m2", pa.binary())])


class Summary:
    """Count, exact sums (whole numbers, ``SHIFT`` taken off), singular values and right vectors of the centred rows."""

    def __init__(self, n: int, sums: list[int], s: np.ndarray, vt: np.ndarray):
        self.n, self.sums, self.s, self.vt = n, sums, s, vt

    @classmethod
    def of(cls, rows: np.ndarray) -> Summary:
        """``rows``: whole numbers, one vector each."""
        sums = exact_sums(rows)
        mean = np.array([x / len(rows) for x in sums])
        _, s, vt = np.linalg.svd(rows.astype(float) - mean, full_matrices=False)
        return cls(len(rows), sums, s, vt)

    def mean(self) -> np.ndarray:
        return np.array([x / self.n for x in self.sums])

    def merge(self, other: Summary) -> Summary:
        apart = np.sqrt(self.n / (self.n + other.n) * other.n) * (self.mean() - other.mean())
        stacked = np.vstack([self.s[:, None] * self.vt, other.s[:, None] * other.vt, apart])
        _, s, vt = np.linalg.svd(stacked, full_matrices=False)
        return Summary(self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], s, vt)

    def row(self, part: int) -> pa.RecordBatch:
        values = [part, self.n, " ".join(map(str, self.sums)).encode(), self.s.astype("<f8").tobytes(), self.vt.astype("<f8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, PART_ARROW, strict=True)], schema=PART_ARROW)

    @classmethod
    def read(cls, n: int, sums: bytes, s: bytes, vt: bytes) -> Summary:
        values = np.frombuffer(s, "<f8")
        return cls(n, [int(x) for x in sums.split()], values, np.frombuffer(vt, "<f8").reshape(len(values), -1))


def exact_sums(rows: np.ndarray) -> list[int]:
    """Sums of each dimension, past 64 bits where they need to be."""
    largest = int(np.abs(rows).max(initial=0))
    return [int(x) for x in (rows if largest * len(rows) < 1 << 62 else rows.astype(object)).sum(axis=0)]


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers, ``SHIFT`` taken off."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64) - SHIFT


def blocks(batches: Iterator[pa.RecordBatch], dims: int, column: str, step: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            yield part, matrix(part.column(column), dims)


def merged_tree(parts: DataFrame, schema: str, merge: Callable[[pa.Table], pa.RecordBatch]) -> list:
    """Merge the summaries of ``parts``, numbered by ``_part``, ``FAN`` at a time; the last one, or nothing for no parts."""
    now = cut(parts)
    count = (now.agg(F.max("_part")).first()[0] or 0) + 1
    while count > 1:
        now = cut(now.withColumn("_part", F.floor(F.col("_part") / FAN).cast("int")).groupBy("_part").applyInArrow(lambda t: pa.Table.from_batches([merge(t)]), schema))
        count = -(-count // FAN)
    return now.collect()


def _merge_summaries(table: pa.Table) -> pa.RecordBatch:
    rows = table.sort_by([("n", "ascending"), ("sums", "ascending")]).to_pylist()
    out = None
    for r in rows:
        one = Summary.read(r["n"], r["sums"], r["s"], r["vt"])
        out = one if out is None else out.merge(one)
    return out.row(rows[0]["_part"])


def decompose(vectors: DataFrame, dims: int, column: str = "_x") -> Summary | None:
    """The summary of all ``vectors``; None without any."""
    step = max(1, BLOCK // dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, rows in blocks(batches, dims, column, step):
            one = Summary.of(rows)
            held = one if held is None else held.merge(one)
        if held is not None:
            yield held.row(TaskContext.get().partitionId())

    found = merged_tree(vectors.select(column).mapInArrow(partial, PART), PART, _merge_summaries)
    return Summary.read(found[0]["n"], bytes(found[0]["sums"]), bytes(found[0]["s"]), bytes(found[0]["vt"])) if found else None


def _joined_moments(a: tuple, b: tuple) -> tuple:
    """(n, mean, centred cross products) of two sets together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] / n * b[0])


def _moments_row(part: int, m: tuple) -> pa.RecordBatch:
    values = [part, m[0], m[1].astype("<f8").tobytes(), m[2].astype("<f8").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, MOMENTS_ARROW, strict=True)], schema=MOMENTS_ARROW)


def _read_moments(n: int, mean: bytes, m2: bytes) -> tuple:
    mean = np.frombuffer(mean, "<f8")
    return n, mean, np.frombuffer(m2, "<f8").reshape(len(mean), -1)


def _merge_moments(table: pa.Table) -> pa.RecordBatch:
    out = None
    for r in table.sort_by([("n", "ascending"), ("mean", "ascending")]).to_pylist():
        one = _read_moments(r["n"], r["mean"], r["m2"])
        out = one if out is None else _joined_moments(out, one)
    return _moments_row(table["_part"][0].as_py(), out)


def identity_error(vectors: DataFrame, dims: int, mean: np.ndarray, weights: np.ndarray, column: str = "_x") -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, taken over all of them."""
    step = max(1, BLOCK // dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, rows in blocks(batches, dims, column, step):
            made = (rows.astype(float) - mean) @ weights
            middle = made.mean(axis=0)
            made -= middle
            one = len(made), middle, made.T @ made
            held = one if held is None else _joined_moments(held, one)
        if held is not None:
            yield _moments_row(TaskContext.get().partitionId(), held)

    found = merged_tree(vectors.select(column).mapInArrow(partial, MOMENTS), MOMENTS, _merge_moments)[0]
    n, _, m2 = _read_moments(found["n"], bytes(found["mean"]), bytes(found["m2"]))
    return float(np.abs(m2 / n - np.eye(len(m2))).max())


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 for each row, exact; None past 63 bits."""
    most = max(map(abs, sums), default=0) + n * int(np.abs(rows).max(initial=0))
    if most * most * rows.shape[1] < 1 << 63:
        apart = n * rows - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = n * rows.astype(object) - np.array(sums, object)
    return [x if x < 1 << 63 else None for x in map(int, (apart * apart).sum(axis=1))]


def usable_vectors(rows: DataFrame, vector_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``_x`` array<long>: whole-number vectors of the rows whose entries are all there, finite and within 2^50."""
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    given = rows.select(*map(col, keep), col(vector_col).cast("array<double>").alias("_v")).where("_v IS NOT NULL AND size(_v) > 0")
    sound = given.where(F.forall("_v", lambda c: F.coalesce((c >= -(2.0**50)) & (c <= 2.0**50), F.lit(False))))
    return sound.select(*map(col, keep), F.transform("_v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("_x"))


def whiten(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", most: int = 16) -> DataFrame:
    """Whitened components of each vector: id_col, component, n, deviation, whitened, explained, identity_error.

    Rows are left out whose vector is null, empty, holds null or non-finite
    entries or some past 2^50, or has another length than most vectors (of equally
    frequent lengths the largest is taken).  Each distinct vector counts once in the
    fit, whatever the copies; each row is whitened, so repeated rows and ids stay as
    many as they are.  Components without variance (rank) have no rows.  ``deviation``
    is null past 63 bits.  An empty table gives no rows.
    """
    schema = rows.select(F.col("`" + id_col.replace("`", "``") + "`"), *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]).schema
    given = usable_vectors(rows, vector_col, [id_col])
    lengths = given.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims = lengths["d"]
    given = given.where(F.size("_x") == dims)
    fit = cut(given.select("_x").distinct())
    whole = decompose(fit, dims)
    n, sums, mean = whole.n, whole.sums, whole.mean()
    real = whole.s > whole.s.max(initial=0) * max(dims, len(whole.s)) * np.finfo(float).eps
    count = min(most, int(real.sum()))
    if not count:
        return rows.sparkSession.createDataFrame([], schema)
    # whitened = (x - mean) . v / sqrt(e), with e = s^2 / n.
    weights = whole.vt[:count].T * (np.sqrt(n) / whole.s[:count])
    explained = whole.s[:count] ** 2 / (whole.s**2).sum()
    error = identity_error(fit, dims, mean, weights)

    step = max(1, BLOCK // dims)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, dims, "_x", step):
            size = len(x) * count
            each = pa.array(np.repeat(np.arange(len(x)), count))
            made = ((x.astype(float) - mean) @ weights).reshape(-1)
            columns = [part.column(0).take(each), np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)), np.full(size, n), pa.array(deviations(x, n, sums), pa.int64()).take(each), made, np.tile(explained, len(x)), np.full(size, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    return given.mapInArrow(project, schema)
