"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model holds counts of byte contexts.  A token is read as space, bytes, space
(the end of a document is the empty token).  Contexts are the last 0 to
``order`` bytes, back to the text's begin, so that a word is predicted from the
end of the one before; or, ``within_tokens``, back to the token's first space.
Each byte is coded in the longest context seen; when it is new there, an escape
(method C: distinct symbols / (count + distinct symbols)) leads to the context
one byte shorter, where the symbols already ruled out are excluded from the
counts.  After order 0 comes a uniform choice of the symbols left.

Across tokens, gram counts stay dealt by the last two bytes of their contexts,
where a context meets all its shorter ones but those of one byte and none,
which every task has.  Within tokens, all of them make up one trie.

Training tokens are counted over all training documents.  Counts of the
``frequent`` most frequent tokens go to every task; those of the others are
joined by token hash, in packed arrays, and never gathered in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

SYMBOLS = 257
B56 = np.uint64(56)


class Trie:
    """Context counts as sorted arrays: a gram is a context and the byte after it, keyed by length and bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None):
        """``keys``/``counts``: grams in the longest context of their positions; shorter contexts are summed here.

        With ``low``, the counts of all grams of one and two bytes, ``keys`` are longer and only their contexts of two
        bytes or more are summed.
        """
        self.order = order
        levels_k, levels_c = ([keys], [counts]) if low is None else ([keys, low[0]], [counts, low[1]])
        while len(keys):
            n = keys >> B56
            longer = n > (1 if low is None else 3)
            keys, counts = _suffix(keys[longer]), counts[longer]
            levels_k.append(keys)
            levels_c.append(counts)
        self.grams, place = np.unique(np.concatenate(levels_k), return_inverse=True)
        self.c = np.bincount(place, np.concatenate(levels_c), len(self.grams)).astype(np.float64)
        contexts = _context(self.grams)
        self.contexts, first, self.owner = np.unique(contexts, return_index=True, return_inverse=True)
        if not len(self.grams):
            self.n = self.q = self.n_left = self.q_left = np.zeros(0)
            return
        # Grams are sorted by length, then bytes, so those of a context are neighbours.
        self.n, self.q = np.add.reduceat(self.c, first), np.diff(np.append(first, len(self.grams))).astype(np.float64)
        has = (self.contexts >> B56) > 0
        below = np.zeros(len(self.contexts), np.int64)
        below[has] = np.searchsorted(self.contexts, _suffix(self.contexts[has]))
        longer = (self.grams >> B56) > 1
        shadow = np.zeros(len(self.grams))
        shadow[longer] = self.c[np.searchsorted(self.grams, _suffix(self.grams[longer]))]
        self.n_left = np.where(has, self.n[below] - np.add.reduceat(shadow, first), 0)
        self.q_left = np.where(has, self.q[below] - self.q, 0)

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each token."""
        text = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.uint64)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        ends = np.cumsum(sizes)
        place = np.arange(len(text)) - np.repeat(ends - sizes, sizes)
        pos = np.flatnonzero(place > 0)
        room = np.minimum(place[pos], self.order)
        owner = np.repeat(np.arange(len(words)), sizes)[pos]
        value = text[pos]
        for j in range(1, self.order + 1):
            value = np.where(room >= j, value | (text[np.maximum(pos - j, 0)] << np.uint64(8 * j)), value)
        return np.bincount(owner, self.score_grams(value | ((room + 1).astype(np.uint64) << B56)), len(words))

    def score_grams(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        sizes = grams >> B56
        lp, before = np.zeros(len(grams)), np.full(len(grams), -1)
        todo = np.arange(len(grams))
        for length in range(self.order + 1, 0, -1):
            on = sizes[todo] >= length
            at, rest = todo[on], todo[~on]
            key = (grams[at] & np.uint64((1 << 8 * length) - 1)) | np.uint64(length << 56)
            g = np.minimum(np.searchsorted(self.grams, key), max(0, len(self.grams) - 1))
            hit = self.grams[g] == key if len(self.grams) else np.zeros(len(at), bool)
            found, prev = at[hit], before[at[hit]]
            k = g[hit]
            top, of = prev < 0, self.owner[k] if len(k) else k
            with np.errstate(divide="ignore", invalid="ignore"):
                lp[found] += np.log10(self.c[k] / np.where(top, self.n[of] + self.q[of], self.n_left[prev] + self.q_left[prev])) if len(k) else 0
            missed, context = at[~hit], _context(key[~hit])
            x = np.minimum(np.searchsorted(self.contexts, context), max(0, len(self.contexts) - 1))
            seen = self.contexts[x] == context if len(self.contexts) else np.zeros(len(missed), bool)
            where, x, prev = missed[seen], x[seen], before[missed[seen]]
            if len(where):
                top = prev < 0
                esc = np.where(top, self.q[x], self.q_left[prev])
                all_of = np.where(top, self.n[x] + self.q[x], self.n_left[prev] + self.q_left[prev])
                # Where nothing is left after the exclusion, escaping is certain.
                lp[where] += np.log10(np.where((all_of > 0) & (esc > 0), esc, 1) / np.where((all_of > 0) & (esc > 0), all_of, 1))
                before[where] = x
            todo = np.concatenate([rest, missed])
        lp[todo] -= np.log10(SYMBOLS - (self.q[0] if len(self.q) else 0))
        return lp


def _suffix(keys: np.ndarray) -> np.ndarray:
    """Without the first byte."""
    n = (keys >> B56) - np.uint64(1)
    return (n << B56) | (keys & ((np.uint64(1) << (n * np.uint64(8))) - np.uint64(1)))


def _context(keys: np.ndarray) -> np.ndarray:
    """Without the last byte."""
    return (((keys >> B56) - np.uint64(1)) << B56) | ((keys & np.uint64((1 << 56) - 1)) >> np.uint64(8))


def longest_grams(words: list[bytes], counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram in the longest context of each position of the tokens, and its weight, summed."""
    text = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weight = np.repeat(counts, sizes)
    pos = np.flatnonzero(place > 0)
    room = np.minimum(place[pos], order)
    value = text[pos]
    for j in range(1, order + 1):
        value = np.where(room >= j, value | (text[np.maximum(pos - j, 0)] << np.uint64(8 * j)), value)
    keys, at = np.unique(value | ((room + 1).astype(np.uint64) << B56), return_inverse=True)
    return keys, np.bincount(at, weight[pos], len(keys)).astype(np.int64)


def text_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each byte of the texts in its context of up to ``order`` bytes, across tokens; the count of each text.

    A text is read as space, its tokens with one space after each, space.
    """
    streams = [b" " + b" ".join([*t.lower().split(), b""]) + b" " for t in texts]
    text = np.frombuffer(b"".join(streams), np.uint8)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    value = text.astype(np.uint64)
    for j in range(1, order + 1):
        value[j:] |= text[: max(0, len(text) - j)].astype(np.uint64) << np.uint64(8 * j)
    begins = np.cumsum(sizes) - sizes
    for n in range(1, order + 1):
        short = begins[sizes > n] + n
        value[short] &= np.uint64((1 << 8 * (n + 1)) - 1)
        value[short] |= np.uint64((n + 1) << 56)
    deep = np.ones(len(text), bool)
    for n in range(order + 1):
        deep[begins[sizes > n] + n] = False
    value[deep] |= np.uint64((order + 1) << 56)
    return np.delete(value, begins), sizes - 1


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = pa.table({"k": keys, "c": counts}).group_by("k", use_threads=False).aggregate([("c", "sum")])
    return t.column("k").to_numpy(), t.column("c_sum").to_numpy()


class WordTable(dict):
    """token -> number; score, base score if frequent, whether frequent, hash, by number."""

    def __init__(self, trie: Trie | None, frequent: dict[bytes, int], floor: float, most: int = 400_000):
        super().__init__()
        self.trie, self.frequent, self.floor, self.most = trie, frequent, floor, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.score = self.base = np.zeros(0)
        self.known = np.zeros(0, bool)
        self.hash = np.zeros(0, np.uint64)

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all texts, the end token last in each; the count of each text."""
        if len(self) > self.most:
            self.reset()
        known, places = len(self), []
        for t in texts:
            words = t.lower().split()
            words.append(b"")
            places.append([self.setdefault(w, len(self)) for w in words])
        if len(self) > known:
            new = [w for w, _ in zip(reversed(self), range(len(self) - known), strict=False)][::-1]
            c = np.fromiter((self.frequent.get(w, 0) for w in new), np.int64, len(new))
            self.known = np.concatenate([self.known, c > 0])
            self.base = np.concatenate([self.base, np.where(c > 0, np.log10(c + 0.5) - self.floor, 0)])
            self.hash = np.concatenate([self.hash, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
            if self.trie is not None:
                parts = [self.trie.score(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
                self.score = np.concatenate([self.score, *parts])
        sizes = np.fromiter(map(len, places), np.int64, len(places))
        return np.fromiter((i for p in places for i in p), np.int64, int(sizes.sum())), sizes


def _chunks(column, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(place, texts) of about ``most`` bytes each."""
    texts, size, begin = [], 0, 0
    for i in range(len(column)):
        texts.append(column[i].as_py())
        size += len(texts[-1])
        if size >= most:
            yield begin, texts
            texts, size, begin = [], 0, i + 1
    if texts:
        yield begin, texts


def _in_buckets(names: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    # Sixteen-bit keys are sorted by radix.
    order = np.argsort(names.astype(np.uint16) if len(names) and int(names.max()) < 1 << 16 else names, kind="stable")
    names, rows = names[order], rows[order]
    which, begins = np.unique(names, return_index=True)
    ends = np.append(begins[1:], len(names))[: len(begins)]
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array([rows[i:j].tobytes() for i, j in zip(begins, ends, strict=True)], pa.binary())], names=["bucket", "blob"])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def token_counts(train: DataFrame, most: int = 300_000) -> DataFrame:
    """(word binary, c) over the ``_b`` texts of all rows, the end token as the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return out

        for b in batches:
            for t in b.column(0):
                held.update(t.as_py().lower().split())
                held[b""] += 1
                if len(held) > most:
                    yield flush()
        if held:
            yield flush()

    return train.select("_b").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_from(counts: DataFrame, most: int, steps: int = 64) -> int:
    """The least count from which there are ``most`` tokens or fewer, by a histogram of at most 64 * ``steps`` bars."""
    bar = F.floor(F.log2(F.col("c")) * steps).cast("int")
    bars = sorted(counts.groupBy(bar.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["b"])
    least, total = 1 << 62, 0
    for r in bars:
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    return least


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, order: int = 5, frequent: int = 100_000,
    within_tokens: bool = True, block: int = 16 << 20,
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The documents whose crc32(id as text) mod ``folds`` is ``held_out`` are not
    learned from; all are scored.  Null text is empty and has the end token
    only; a null id counts as the empty text.  Tokens are words between ASCII
    white space with A-Z lower-cased, then one end.  ``base_score`` is the
    smoothed unigram score; ``score`` the log10 probability of the tokens, with
    contexts back to the token's begin or, unless ``within_tokens``, across
    tokens.  Then texts are dealt into blocks of about ``block`` bytes; a block
    asks once for each of its grams where the grams of that context are counted.
    Repeated rows are learned from and scored each.  With no training document
    every token is unknown and each symbol uniform.  Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_b"),
        (F.pmod(F.crc32(name.cast("binary")), F.lit(folds)) == held_out).alias("_held"),
    ).withColumn("_key", F.xxhash64("_id", "_b"))

    counts = cut(token_counts(base.where("NOT _held")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    floor = float(np.log10(n + 0.5 * (v + 1)))
    least = frequent_from(counts, frequent)
    top = {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= least).collect()}

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k, c = longest_grams(b.column(0).to_pylist(), b.column(1).to_numpy(), order if within_tokens else 1)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["gram", "c"])

    # At most one gram per context and symbol: its number is that of the trie's leaves, not of the tokens.
    # Across tokens only grams of one and two bytes are taken from here (256^2 + 256 at most): they never cross a border.
    found = counts.mapInArrow(grams, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).toArrow()
    trie = Trie(found.column("gram").to_numpy().view(np.uint64), found.column("c").to_numpy().astype(np.float64), order)
    shared = sc.broadcast((trie if within_tokens else None, top))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), v // 150_000)

    ask, answer = np.dtype([("key", "<i8"), ("hash", "<u8")]), np.dtype([("key", "<i8"), ("base", "<f8"), ("known", "<i4")])
    tell = np.dtype([("hash", "<u8"), ("c", "<i8")])

    def rare_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = WordTable(None, shared.value[1], floor), []
        for b in batches:
            keys = b.column(1).to_numpy()
            for begin, texts in _chunks(b.column(0)):
                at, sizes = table.numbers(texts)
                rare = ~table.known[at]
                out = np.empty(int(rare.sum()), ask)
                out["key"], out["hash"] = np.repeat(keys[begin : begin + len(texts)], sizes)[rare], table.hash[at][rare]
                held.append(out)
                if sum(map(len, held)) > 400_000:
                    rows = np.concatenate(held)
                    held.clear()
                    yield _in_buckets(_bucket(rows["hash"], buckets), rows)
        if sum(map(len, held)):
            rows = np.concatenate(held)
            yield _in_buckets(_bucket(rows["hash"], buckets), rows)

    def rare_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            keep = [i for i, w in enumerate(words) if w not in shared.value[1]]
            if keep:
                rows = np.empty(len(keep), tell)
                rows["hash"] = np.fromiter((xxhash.xxh64_intdigest(words[i]) for i in keep), np.uint64, len(keep))
                rows["c"] = b.column(1).to_numpy()[keep]
                yield _in_buckets(_bucket(rows["hash"], buckets), rows)

    def meet(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        asked = np.concatenate([np.frombuffer(x, ask) for k, x in zip(kinds, blobs, strict=True) if k == "ask"] or [np.zeros(0, ask)])
        told = np.concatenate([np.frombuffer(x, tell) for k, x in zip(kinds, blobs, strict=True) if k == "tell"] or [np.zeros(0, tell)])
        told = told[np.argsort(told["hash"])]
        c = np.zeros(len(asked), np.int64)
        if len(told):
            at = np.minimum(np.searchsorted(told["hash"], asked["hash"]), len(told) - 1)
            c = np.where(told["hash"][at] == asked["hash"], told["c"][at], 0)
        keys, place = np.unique(asked["key"], return_inverse=True)
        out = np.empty(len(keys), answer)
        out["key"], out["base"], out["known"] = keys, np.bincount(place, np.log10(c + 0.5) - floor, len(keys)), np.bincount(place, c > 0, len(keys))
        return pa.Table.from_batches([_in_buckets(_bucket(keys.view(np.uint64), buckets), out)])

    def total(t: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, answer) for x in t.column("blob").to_pylist()])
        keys, place = np.unique(rows["key"], return_inverse=True)
        sums = [np.bincount(place, rows[c], len(keys)) for c in ("base", "known")]
        return pa.table({"_k": pa.array(keys), "_rb": pa.array(sums[0]), "_rk": pa.array(sums[1].astype(np.int64))})

    asked = base.select("_b", "_key").mapInArrow(rare_tokens, "bucket long, blob binary").withColumn("kind", F.lit("ask"))
    told = counts.mapInArrow(rare_counts, "bucket long, blob binary").withColumn("kind", F.lit("tell"))
    answers = asked.unionByName(told).groupBy("bucket").applyInArrow(meet, "bucket long, blob binary")
    rare = answers.groupBy("bucket").applyInArrow(total, "_k long, _rb double, _rk long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value[0], shared.value[1], floor)
        for b in batches:
            for begin, texts in _chunks(b.column(0)):
                at, sizes = table.numbers(texts)
                begins = np.cumsum(sizes) - sizes
                part = b.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(sizes), pa.array(np.add.reduceat(table.known[at].astype(np.int64), begins)),
                     pa.array(np.add.reduceat(table.base[at], begins)), pa.array(np.add.reduceat(table.score[at], begins))],
                    names=[*part.schema.names[1:], "_n", "_known", "_base", "_score"],
                )

    thin = base.select("_b", "_id", "_held", "_key")
    kind = thin.schema["_id"].dataType.simpleString()
    fields = f"_id {kind}, _held boolean, _key long, _n long, _known long, _base double, _score double"
    if within_tokens:
        scored = cut(thin.mapInArrow(rows, fields))
    else:
        scored = cut(_score_across(thin, fields, sc.broadcast((trie.grams, trie.c)), shared, floor, order, block))
    # Rows that repeat id and text have asked once each under one key, so their sums are shared out.
    again = scored.groupBy("_key").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").withColumnRenamed("_key", "_k2")
    out = scored.join(rare, F.col("_key") == F.col("_k"), "left").join(again, F.col("_key") == F.col("_k2"), "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce(F.col("_rk") / F.col("_m"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce(F.col("_rb") / F.col("_m"), F.lit(0.0))).alias("base_score"),
        F.col("_score").alias("score"),
    )


def _score_across(thin: DataFrame, fields: str, low, shared, floor: float, order: int, block: int) -> DataFrame:
    """The scores of the texts with contexts across tokens; gram counts stay dealt by the last two bytes of the context."""
    size = thin.agg(F.coalesce(F.sum(F.octet_length("_b")), F.lit(0))).first()[0]
    blocks = size // block + 1
    buckets = max(int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (64 << 20))
    told, priced = np.dtype([("gram", "<u8"), ("c", "<u4")]), np.dtype([("gram", "<u8"), ("lp", "<f8")])

    def ask(t: pa.Table) -> pa.Table:
        """Each gram of a block with its count in training texts, by bucket."""
        t = t.combine_chunks()
        held, parts, n = t.column("_held").to_numpy(), [], 0
        for begin, texts in _chunks(t.column("_b")):
            k, sizes = text_grams(texts, order)
            parts.append(_summed(k, np.repeat((~held[begin : begin + len(texts)]).astype(np.int64), sizes)))
            n += len(parts[-1][0])
            if n > 4_000_000:
                parts = [_summed(*map(np.concatenate, zip(*parts, strict=True)))]
                n = 0
        k, c = _summed(*map(np.concatenate, zip(*parts, strict=True)))
        by = np.argsort(k)
        out = np.empty(len(k), told)
        out["gram"], out["c"] = k[by], c[by]
        group = (out["gram"] >> np.uint64(8)) & np.uint64(0xFFFF)
        group = (group * np.uint64(0x9E37) & np.uint64(0xFFFF)) * np.uint64(buckets) >> np.uint64(16)
        b = _in_buckets(group, out)
        return pa.table({"bucket": b.column(0), "_block": pa.array([t.column("_block")[0].as_py()] * b.num_rows, pa.int64()), "blob": b.column(1)})

    def price(t: pa.Table) -> pa.Table:
        """All grams whose contexts end alike meet here."""
        asked = [np.frombuffer(x.as_py(), told) for x in t.column("blob")]
        k, c = _summed(np.concatenate([a["gram"] for a in asked]), np.concatenate([a["c"] for a in asked]).astype(np.int64))
        by = np.argsort(k)
        k, c = k[by], c[by]
        own = (c > 0) & (k >> B56 > 2)
        lp = Trie(k[own], c[own].astype(np.float64), order, low.value).score_grams(k)
        blobs = []
        for a in asked:
            out = np.empty(len(a), priced)
            out["gram"], out["lp"] = a["gram"], lp[np.searchsorted(k, a["gram"])]
            blobs.append(out.tobytes())
        return pa.table({"_block": t.column("_block"), "blob": pa.array(blobs, pa.binary())})

    def total(t: pa.Table, prices: pa.Table) -> pa.Table:
        t, table, out = t.combine_chunks(), WordTable(None, shared.value[1], floor), []
        known = np.concatenate([np.frombuffer(x.as_py(), priced) for x in prices.column("blob")])
        known, lp = pa.array(known["gram"]), np.ascontiguousarray(known["lp"])
        for begin, texts in _chunks(t.column("_b")):
            k, lengths = text_grams(texts, order)
            each = lp[pc.index_in(pa.array(k), known).to_numpy()]
            at, sizes = table.numbers(texts)
            begins = np.cumsum(sizes) - sizes
            out.append((sizes, np.add.reduceat(table.known[at].astype(np.int64), begins), np.add.reduceat(table.base[at], begins), np.add.reduceat(each, np.cumsum(lengths) - lengths)))
        made = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
        return pa.table([t.column("_id"), t.column("_held"), t.column("_key"), *made], names=["_id", "_held", "_key", "_n", "_known", "_base", "_score"])

    dealt = thin.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("long"))
    asked = dealt.groupBy("_block").applyInArrow(ask, "bucket long, _block long, blob binary")
    prices = asked.groupBy("bucket").applyInArrow(price, "_block long, blob binary")
    return dealt.groupBy("_block").cogroup(prices.groupBy("_block")).applyInArrow(total, fields)
