"""Toxicity by a classifier chain: linear models in a row, each fed the earlier categories' probabilities.

The models after the first are trained with out-of-fold predictions of the
earlier ones, so that they see probabilities as uncertain as those of new
documents.  Features are hashed words and word beginnings (4 to 6 bytes), as
counts over the square root of the document's length.  The models are fitted on
the driver on a bounded sample of labelled rows (``max_train``); scoring is one
scan over all whole texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seed words of the first two categories; the last is the label itself.
SEEDS = {
    "insult": ("clown", "idiot", "loser", "moron", "scum", "stupid"),
    "contempt": ("disgusting", "pathetic", "trash", "worthless"),
}
STRIP = b".,;:!?|\"'()[]{}<>*#$%&-_"


def word_features(word: bytes) -> tuple[int, ...]:
    """32-bit hashes of the word and of its beginnings; none for bare punctuation."""
    core = word.strip(STRIP)
    if not core:
        return ()
    return tuple({zlib.crc32(b"w" + core), *(zlib.crc32(b"p" + core[:n]) for n in (4, 5, 6) if len(core) > n)})


class _Features(dict):
    """word -> the features of it that are wanted, or all."""

    def __init__(self, wanted: dict[int, int] | None = None, most: int = 400_000):
        super().__init__()
        self.wanted, self.most = wanted, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > self.most:
            self.clear()
        found = word_features(word)
        self[word] = found = found if self.wanted is None else tuple(self.wanted[f] for f in found if f in self.wanted)
        return found


def _counts(text: bytes | None, features: _Features) -> tuple[Counter, int]:
    words, n = (text or b"").lower().split(), Counter()
    for w, k in Counter(words).items():
        for f in features[w]:
            n[f] += k
    return n, len(words)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2e-3, steps: int = 120, rate: float = 0.15) -> np.ndarray:
    """Weights, the constant last, by Adam over all rows; a constant label gives a constant model.

    In double precision: the constant's first gradient is 0, and Adam would
    take whole steps after single precision's rounding, that is after the order of the rows.
    """
    positive = min(max(float(y.mean(dtype=np.float64)), 1e-4), 1 - 1e-4) if len(y) else 1e-4
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(positive / (1 - positive))
    if not len(y) or y.min() == y.max():
        return w.astype(np.float32)
    rows = np.ones((len(x), len(w)))
    rows[:, :-1] = x
    scale = np.append(1 / np.maximum(np.sqrt(np.einsum("ij,ij->j", rows, rows)[:-1] / len(x)), 1e-3), 1)
    rows *= scale
    m, v = np.zeros_like(w), np.zeros_like(w)
    shrink = np.append(np.full(len(w) - 1, ridge), 0)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        g = rows.T @ (p - y) / len(y) + shrink * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return (w * scale).astype(np.float32)


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: int = 3) -> list[np.ndarray]:
    """A model per column of ``labels``; each sees x and the out-of-fold probabilities of the columns before."""
    fold, models = np.arange(len(x)) % folds, []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float32)
        models.append(fit_logistic(x, y))
        out = np.zeros(len(x), np.float32)
        for f in range(folds):
            if (fold == f).any():
                out[fold == f] = predict(x[fold == f], fit_logistic(x[fold != f], y[fold != f]))
        x = np.hstack([x, out[:, None]])
    return models


def run_chain(x: np.ndarray, models: Sequence[np.ndarray]) -> np.ndarray:
    for w in models:
        x = np.hstack([x, predict(x, w)[:, None].astype(np.float32)])
    return x[:, x.shape[1] - len(models) :]


def train(
    docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], id_col: str, text_col: str, max_train: int, max_features: int
) -> tuple[dict[int, int], list[np.ndarray]]:
    """(feature hash -> column, models) from at most ``max_train`` labelled ids, chosen by a hash of their id, and twice as many rows.

    ``categories``: (name, Boolean column over the labels' columns and ``_text``).
    """
    said = [c for c in labels.columns if c not in (id_col, "_id", "_lid", "_text")]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.max(F.struct(*said)).alias("_said"))
    chosen = known.orderBy(F.xxhash64("_lid"), "_lid").limit(max_train).select("_lid", "_said.*")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # The chosen rows are max_train at most, so they may be broadcast.
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).select(
        F.xxhash64("_id", "_text").alias("_order"), F.col("_text").cast("binary").alias("_b"),
        *[F.coalesce(c.cast("int"), F.lit(0)).alias(f"_y{i}") for i, (_, c) in enumerate(categories)],
    )
    n_y = len(categories)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for b in batches:
            got = [_counts(t, features) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([np.fromiter(c, np.uint32, len(c)).tobytes() for c, _ in got], pa.binary()),
                 pa.array([np.fromiter(c.values(), np.uint32, len(c)).tobytes() for c, _ in got], pa.binary()), pa.array([n for _, n in got], pa.int64()), *b.columns[2:]],
                names=["o", "f", "c", "n", *[f"y{i}" for i in range(n_y)]],
            )

    made = rows.mapInArrow(featurise, "o long, f binary, c binary, n long, " + ", ".join(f"y{i} int" for i in range(n_y)))
    # An id may have many rows; twice max_train rows at most are used and sent.
    found = made.orderBy("o", "n").limit(2 * max_train).collect()
    y = np.array([[r[f"y{i}"] for i in range(n_y)] for r in found], np.int8).reshape(len(found), n_y)
    ids = [np.frombuffer(r["f"], np.uint32) for r in found]
    every, place = np.unique(np.concatenate([*ids, np.zeros(0, np.uint32)]), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    last = y[:, -1] if len(y) else np.zeros(0)
    n1, n0 = max(1, last.sum()), max(1, len(last) - last.sum())
    in1 = np.bincount(place[last[owner] == 1] if len(place) else [], minlength=len(every)) / n1
    in0 = np.bincount(place[last[owner] == 0] if len(place) else [], minlength=len(every)) / n0
    spread = np.sqrt((in1 + in0) / 2 + 1 / n1)
    best = np.argsort(-np.abs(in1 - in0) / spread, kind="stable")[:max_features]
    column = np.full(len(every), -1, np.int64)
    column[best] = np.arange(len(best))
    x = np.zeros((len(found), len(best)), np.float32)
    if len(found):
        counts = np.concatenate([np.frombuffer(r["c"], np.uint32) for r in found])
        length = np.sqrt(np.maximum(1, np.array([r["n"] for r in found], np.float32)))
        keep = column[place] >= 0
        x[owner[keep], column[place[keep]]] = counts[keep] / length[owner[keep]]
    return {int(every[b]): i for i, b in enumerate(best)}, fit_chain(x, y)


def default_categories(label: str = "toxic") -> list[tuple[str, Column]]:
    """The seed categories among rows labelled toxic, then the label."""
    yes = F.coalesce(F.col(label).cast("int"), F.lit(0)) > 0
    has = lambda ws: F.coalesce(F.col("_text"), F.lit("")).rlike(r"(?i)\b(?:" + "|".join(ws) + r")\b")
    return [*((name, yes & has(ws)) for name, ws in SEEDS.items()), (label, yes)]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: Sequence[tuple[str, Column]] | None = None,
    threshold: float = 0.4,
    max_train: int = 6000,
    max_features: int = 512,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, p_<category> for each category in chain order, rejected, and the ``keep`` columns.

    Rejected: the last category's probability reaches ``threshold``.  Null and
    empty texts have no features and get the models' constant.  Labels that are
    null count as 0; labels of unknown documents are unused; of repeated labels
    the one with the greatest values is used.  Without labelled rows, or where all agree, the models are
    constants.  Repeated rows get equal scores.  Other columns are ignored.
    """
    categories = list(categories or default_categories())
    vocabulary, models = train(docs, labels, categories, id_col, text_col, max_train, max_features)
    names, n_f = [n for n, _ in categories], len(vocabulary)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = np.zeros((part.num_rows, n_f), np.float32)
                for i, t in enumerate(part.column(0).to_pylist()):
                    n, length = _counts(t, features)
                    if n:
                        x[i, np.fromiter(n, np.int64, len(n))] = np.fromiter(n.values(), np.float32, len(n)) / np.sqrt(max(1, length))
                p = run_chain(x, models).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array(p[:, -1] >= threshold)],
                    names=[*part.schema.names[1:], *[f"p_{n}" for n in names], "rejected"],
                )

    passed = docs.select(F.col(text_col).cast("string").cast("binary").alias("_b"), F.col(id_col), *[F.col(c) for c in keep])
    made = [*(T.StructField(f"p_{n}", T.DoubleType()) for n in names), T.StructField("rejected", T.BooleanType())]
    return passed.mapInArrow(score, T.StructType([*passed.schema.fields[1:], *made]))
