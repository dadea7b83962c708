"""Exact n-gram Jaccard join by vertical partitioning.

Shingles are put in one global order, that of their 64-bit hashes, and the
order is cut into fragments.  Two sets whose sizes are in ratio and whose
Jaccard similarity is t or more differ in at most H = (1-t)/(1+t) * (|a|+|b|)
shingles; cut into F > H fragments, they overlap fully in F - H at least.  The
fullest of these is among the H + 1 fullest fragments of both sets, so each set
posts those alone, in the scheme of its size class and of the next, and sets
that post none in common cannot link.  Pairs whose sizes or parity sketches
(two bits a shingle or more) prove that they cannot link are ruled out before
any set is moved.  How many shingles the others share is counted per (coarser)
fragment and summed per pair.

A group of near copies is not expanded into pairs.  Each signature's sets are
first compared with one centre; linked sets are contracted; then each pair of
components that still meets in a signature is tried on its most similar pair,
and last all pairs left over.  Components come out exact, as only pairs that
are proved not to link are left untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bitmap_of, cut, flag_in_bitmap
from .graph import components

M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
S33 = np.uint64(33)
PARTS = 4


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S33)) * M2
    return h ^ (h >> S33)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted and without repeats."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


class WordHashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence when it is shorter; empty without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b"\0short\0" + b" ".join(words))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = out * M3 + h[i : len(h) - k + 1 + i]
    return distinct(mix(out))


def set_id(s: np.ndarray) -> int:
    """64-bit id of a set, as a signed number."""
    total = np.array([int(mix(s ^ M3).sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64)
    return int(mix(total).view(np.int64)[0])


class Schemes:
    """Size classes (bounds grow by 1/t) and their numbers of fragments."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bounds = num, den, [1]

    def of(self, n: int) -> int:
        b = self.bounds
        while b[-1] < n:
            b.append(max(b[-1] + 1, b[-1] * self.den // self.num))
        return int(np.searchsorted(b, n))

    def fragments(self, k: int) -> tuple[int, int]:
        """(most differing shingles H, fragments F > H); a fifth more than H, so that the emptiest need not be posted."""
        self.of(self.bounds[-1] + 1) if k >= len(self.bounds) else None
        most = 2 * self.bounds[k] * (self.den - self.num) // (self.den + self.num)
        return most, most + 2 + most // 5


def signatures(s: np.ndarray, schemes: Schemes) -> np.ndarray:
    """64-bit hashes of the H + 1 fullest fragments of ``s``, in each of the two schemes of its size.

    Of the fragments that two linked sets agree on, the first by (shingles,
    place) comes after at most H others in either set, so both post it.
    """
    found, low = [], schemes.of(len(s))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + M3), dtype=np.uint64)])
    top = s >> np.uint64(32)
    for k in (low, low + 1):
        most, n = schemes.fragments(k)
        if not most:
            continue
        at = np.searchsorted((top * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
        counts = np.diff(at)
        # Eight-bit keys are sorted by radix; which fragments come first depends on what they hold alone.
        fullest = np.argsort(255 - np.minimum(counts, 255).astype(np.uint8), kind="stable")[: most + 1]
        sums = prefix[at[fullest + 1]] - prefix[at[fullest]]
        found.append(mix(mix(sums + counts[fullest].astype(np.uint64) * M2) ^ (fullest.astype(np.uint64) * M3 + np.uint64(k))))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def repeats(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose key occurs more than once, by key."""
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    keep = np.append(same, False) | np.append(False, same) if len(keys) else np.zeros(0, bool)
    return keys[keep], values[order[keep]]


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2^j hash buckets, two a shingle or more: differing bits never outnumber differing shingles."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def differing(sketches: list[bytes], x: np.ndarray, y: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Least number of shingles in which the sets of the places ``x`` and ``y`` of ``sketches`` differ.

    The longer sketch of a pair is folded to the length of the shorter one.
    """
    sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
    flat, begins = np.frombuffer(b"".join(sketches), np.uint8), np.cumsum(sizes) - sizes
    out = np.zeros(len(x), np.int64)
    shorter = np.minimum(sizes[x], sizes[y])
    for width in np.unique(shorter).tolist():
        which = np.flatnonzero(shorter == width)
        for k in range(0, len(which), max(1, block // width)):
            some = which[k : k + max(1, block // width)]
            folded = []
            for rows in (x[some], y[some]):
                one = np.zeros((len(rows), width), np.uint8)
                for turn in range(int(sizes[rows].max()) // width):
                    on = np.flatnonzero(sizes[rows] > turn * width)
                    one[on] ^= flat[begins[rows[on], None] + turn * width + np.arange(width)]
                folded.append(one)
            out[some] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text")).withColumn("_h", F.xxhash64("_text"))


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """(_id, _h, n, set, sketch) of each row of ``_texts``; set and sketch are null without words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            sets = [shingle_set(t.as_py(), k, hashes) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                names=["_id", "_h", "n", "set", "sketch"],
            )

    return docs.select("_id", "_h", F.col("_text").cast("binary")).mapInArrow(rows, "_id long, _h long, n long, set long, sketch binary")


def shared_signatures(docs: DataFrame, k: int, num: int, den: int, buckets: int, chunk: int = 1 << 18) -> DataFrame:
    """(sig, set, m) of the signatures that m different sets post, two at least, one of those that the same sets post.

    Postings travel as packed arrays, one row per bucket of the signature's hash
    and chunk of postings; equal postings of copies are merged before the
    shuffle.  A bucket holds a fixed share of all postings.
    """
    # The bucket says as much of the signature as its size allows; 32 further bits tell its 100,000 postings apart, and
    # sets that meet by accident are only compared in vain.
    pair = np.dtype([("sig", "<u4"), ("set", "<i8")])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, schemes, held, size, seen = WordHashes(), Schemes(num, den), [], 0, set()

        def flush() -> pa.RecordBatch:
            nonlocal size
            full = np.concatenate([x for x, _ in held])
            all_of = np.empty(len(full), pair)
            all_of["sig"], all_of["set"] = full, np.repeat(np.array([x for _, x in held]), [len(x) for x, _ in held])
            at = (full >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            # Sixteen-bit keys are sorted by radix.
            order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")
            all_of, at = all_of[order], at[order]
            names, begins = np.unique(at, return_index=True)
            ends = np.append(begins[1:], len(at))
            held.clear()
            seen.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array([all_of[i:j].tobytes() for i, j in zip(begins, ends, strict=True)], pa.binary())], names=["bucket", "blob"])

        for b in batches:
            for t in b.column(0):
                s = shingle_set(t.as_py(), k, hashes)
                if not len(s) or (name := set_id(s)) in seen:
                    continue
                seen.add(name)
                sig = signatures(s, schemes)
                if len(sig):
                    held.append((sig, name))
                    size += len(sig)
                    if size >= chunk:
                        yield flush()
        if size:
            yield flush()

    def meet(tables: pa.Table) -> pa.Table:
        got = np.concatenate([np.frombuffer(x.as_py(), pair) for x in tables.column("blob")])
        # Most signatures are posted once; only the others are sorted by set as well.
        sig, sets = repeats(got["sig"], got["set"])
        order = np.lexsort((sets, sig))
        sig, sets = sig[order], sets[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (sets[1:] != sets[:-1])) if len(sig) else np.zeros(0, bool)
        sig, sets = repeats(sig[new], sets[new])
        # Signatures that the same sets post say the same: one is kept, named after the sets.
        begins = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(sig)))
        names = mix(np.add.reduceat(mix(sets.view(np.uint64)), begins) + sizes.astype(np.uint64) * M3) if len(sig) else sig
        names, first = np.unique(names, return_index=True)
        begins, sizes = begins[first], sizes[first]
        at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return pa.table({"sig": pa.array(np.repeat(names, sizes).view(np.int64)), "set": pa.array(sets[at]), "m": pa.array(np.repeat(sizes, sizes).astype(np.int64))})

    posted = docs.select(F.col("_text").cast("binary")).mapInArrow(post, "bucket long, blob binary")
    return posted.groupBy("bucket").applyInArrow(meet, "sig long, set long, m long").distinct()


def set_parts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(set, part, n, items) for the documents (_id, _h) in ``wanted``; the order cut into ``PARTS`` fragments."""
    bits = 1 << 23
    key = F.xxhash64("_id", "_h")
    likely = flag_in_bitmap(docs.withColumn("_key", key), "_key", bitmap_of(wanted.select(key.alias("_key")), "_key", bits), bits, "_in", "inner").where("_in")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for t in b.column(0):
                s = shingle_set(t.as_py(), k, hashes)
                if not len(s):
                    continue
                at = np.searchsorted(s, np.arange(1, PARTS, dtype=np.uint64) << np.uint64(64 - PARTS.bit_length() + 1))
                cuts = np.concatenate([[0], at, [len(s)]]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(cuts), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(s)] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([len(s)] * PARTS, pa.int64()), items],
                    names=["set", "part", "n", "items"],
                )

    made = likely.select(F.col("_text").cast("binary")).mapInArrow(rows, "set long, part int, n long, items array<long>")
    return made.groupBy("set", "part").agg(F.first("n").alias("n"), F.first("items").alias("items"))


def linked(pairs: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """Of (a, b) those that link: overlaps counted per fragment, summed per pair."""
    left = parts.select(F.col("set").alias("a"), "part", F.col("n").alias("na"), F.col("items").alias("ia"))
    right = parts.select(F.col("set").alias("b"), "part", F.col("n").alias("nb"), F.col("items").alias("ib"))
    overlap = F.size(F.array_intersect("ia", "ib"))
    return (
        pairs.join(left, "a").join(right, ["b", "part"])
        .select("a", "b", "na", "nb", overlap.alias("o"))
        .groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("o").alias("o"))
        .where(den * F.col("o") >= num * (F.col("na") + F.col("nb") - F.col("o")))
        .select("a", "b")
    )


def _pairs(t: pa.Table, num: int, den: int, best_only: bool, most: int = 100_000) -> dict[str, np.ndarray]:
    """The candidates among the rows of each (sig, i, j) of a table, about ``most`` pairs at a time."""
    sig, i, j = (t.column(c).to_numpy() for c in ("sig", "i", "j"))
    order = np.lexsort((j, i, sig))
    sig, i, j = sig[order], i[order], j[order]
    names, comp, n, own = (t.column(c).to_numpy()[order] for c in ("set", "comp", "n", "_own"))
    sketches = t.column("sketch").to_pylist()
    begins = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    sizes = np.diff(np.append(begins, len(sig)))
    partners = np.repeat(begins + sizes, sizes) - np.arange(len(sig)) - 1
    upto = np.cumsum(partners)
    found: dict[str, list[np.ndarray]] = {c: [] for c in ("a", "b", "ca", "cb", "gap")}
    at = 0
    while at < len(sig):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + most, side="right")))
        times = partners[at:end]
        x = np.repeat(np.arange(at, end), times)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times)
        at = end
        keep = (comp[x] != comp[y]) & ((i[x] == j[x]) | (own[x] != own[y])) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
        x, y = x[keep], y[keep]
        apart = differing(sketches, order[x], order[y])
        keep = (den + num) * apart <= (den - num) * (n[x] + n[y])
        x, y, gap = x[keep], y[keep], (apart / np.maximum(1, n[x] + n[y]))[keep]
        swap = names[y] < names[x]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        made = {"a": names[x], "b": names[y], "ca": np.minimum(comp[x], comp[y]), "cb": np.maximum(comp[x], comp[y]), "gap": gap}
        for c, v in (best_of(made) if best_only else made).items():
            found[c].append(v)
    out = {c: np.concatenate(v) if v else np.zeros(0, np.float64 if c == "gap" else np.int64) for c, v in found.items()}
    return best_of(out) if best_only else out


def best_of(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The row with the least gap of each pair of components."""
    order = np.lexsort((rows["gap"], rows["cb"], rows["ca"]))
    ca, cb = rows["ca"][order], rows["cb"][order]
    first = order[np.append(True, (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1]))] if len(order) else order
    return {c: v[first] for c, v in rows.items()}


def _candidates(groups: DataFrame, num: int, den: int, best_only: bool, buckets: int, block: int = 1024) -> DataFrame:
    """(a, b, ca, cb, gap) of sets of different components that share a signature and may link.

    ``groups`` is (sig, set, comp, n, sketch, m): m sets post sig.  Large groups
    are dealt as pairs of blocks over the buckets, so that none meets in one task.
    """
    n_blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("set"), n_blocks).cast("int")
    dealt = groups.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), n_blocks - 1))).select(
        "sig", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "set", "comp", "n", "sketch"
    )
    bucketed = dealt.withColumn("_bucket", F.pmod(F.xxhash64("sig", "i", "j"), F.lit(buckets)))
    return bucketed.groupBy("_bucket").applyInArrow(lambda t: pa.table(_pairs(t, num, den, best_only)), "a long, b long, ca long, cb long, gap double")


def _may_link(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs that neither sizes nor sketches rule out; only sketches are moved for this."""
    of = info.select("set", "n", "sketch")
    ratio = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    sized = pairs.join(of.toDF("a", "na", "sa"), "a").join(of.toDF("b", "nb", "sb"), "b").where(ratio).select("a", "b", "na", "nb", "sa", "sb")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            apart = differing(b.column(4).to_pylist() + b.column(5).to_pylist(), np.arange(n), np.arange(n, 2 * n))
            keep = (den + num) * apart <= (den - num) * (b.column(2).to_numpy() + b.column(3).to_numpy())
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return sized.mapInArrow(near, "a long, b long")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, bucket_postings: int = 100_000,
    group_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, text_hash (xxhash64 of the text, null: empty).

    A-Z is lower-cased, words are split at ASCII white space, and a document's
    set holds its distinct k-word shingles (the whole sequence when it has fewer
    words).  Two documents link when den * |a & b| >= num * |a | b|;
    component_id is the least id reachable over links.  Null texts and texts
    without words have an empty set and are their own component.  Rows with
    equal sets, repeated ids included, are in one component; a null id is never
    the least, and names only a component that has no other.  Other columns are
    ignored; an empty table gives no rows.  ``group_col`` adds a number for each
    component, unlike ids never shared by two; null for an empty set.
    """
    base = _texts(docs, id_col, text_col)
    rows = cut(document_sets(base, k))
    sets = rows.where(F.col("set").isNotNull()).groupBy("set").agg(F.min(F.struct("_id", "_h")).alias("r"), F.first("n").alias("n"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    session = docs.sparkSession
    buckets = max(int(session.conf.get("spark.sql.shuffle.partitions")), int(total * 5 * (den - num) / (den + num)) // bucket_postings)
    members = cut(shared_signatures(base, k, num, den, buckets))
    posting = members.select("set").distinct()
    info = cut(rows.where(F.col("set").isNotNull()).join(posting, "set", "left_semi").groupBy("set").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that link; only their sets are moved."""
        wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct().join(sets, "set").select("r.*")
        return cut(linked(pairs, cut(set_parts(base, wanted, k)), num, den))

    rank = members.groupBy("set").agg(F.sum("m").alias("score"))
    centre = members.join(rank, "set").groupBy("sig").agg(F.max(F.struct("score", "set"))["set"].alias("c"))
    stars = members.join(centre, "sig").where("set != c").select(F.least("set", "c").alias("a"), F.greatest("set", "c").alias("b")).distinct()
    tested = cut(_may_link(stars, info, num, den))
    labels = components(confirmed(tested).toDF("u", "v"))

    for best_only in (True, False):
        placed = members.join(labels.toDF("set", "comp"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
        mixed = placed.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("sig")
        groups = placed.join(mixed, "sig").join(info, "set")
        found = _candidates(groups, num, den, best_only, buckets)
        if best_only:
            found = found.groupBy("ca", "cb").agg(F.min(F.struct("gap", "a", "b")).alias("p")).select("p.a", "p.b")
        pairs = cut(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        more = confirmed(pairs)
        tested = tested.unionByName(pairs)
        if not more.isEmpty():
            # What was found before is in the labels.
            labels = components(labels.toDF("u", "v").unionByName(more.toDF("u", "v")))

    named = rows.join(labels.toDF("set", "comp"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    least = named.where(F.col("set").isNotNull()).groupBy("comp").agg(F.min("_id").alias("least"))
    own = named.where(F.col("set").isNotNull()).join(least, "comp").select("_id", "_h", "n", F.col("least").alias("c"), F.col("comp").alias("g"))
    return own.unionByName(named.where(F.col("set").isNull()).select("_id", "_h", "n", F.col("_id").alias("c"), F.col("comp").alias("g"))).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("_h").alias("text_hash"),
        *([F.col("g").alias(group_col)] if group_col else []),
    )
