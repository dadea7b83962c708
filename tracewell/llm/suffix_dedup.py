"""Removal of repeated byte strings with run-length BWT indexes.

Long repeats are settled first: texts are cut where the hash of the gram at a
place says so, each piece is prolonged by ``length`` - 1 bytes so that every
window lies in the piece that it starts in, and a piece that a smaller document
also has is removed as a whole.  Only the first document's copy of a piece goes on.

All ``length``-byte windows that are equal have the same least 32-byte gram
(by hash), so the windows around one such anchor can be compared in one place.
The anchors of what is left are counted; those met once drop out through
a bitmap of fixed size.  Around the others, the maximal runs of windows that
share the anchor are posted to the anchor's bucket.  A bucket merges equal
strings, builds a run-compressed Burrows-Wheeler transform of the different
ones with samples at run ends, streams each string through it by LF steps, and
marks windows whose matches include a document with a smaller id.  An index
never holds more than its bucket, and a bucket holds a fixed share of the
postings, of which equal ones are merged before and after the shuffle.  Strings of
different anchors share no window, so a large bucket builds several indexes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bitmap_of, cut, flag_in_bitmap, shuffles_freed

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
GRAM = 32
#: About how many bytes one index holds, if no single anchor's strings are more: what fits into a processor's caches, and into sorts of numbers.
INDEXED = 1 << 19
#: About how many bytes of text are hashed before what is found in them is dealt; the hashing itself takes fewer at a time, for memory.
DEALT = 1 << 22


def _sorted_places(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of ``width`` bits and where each was; equal keys in their order."""
    bits = len(keys).bit_length()
    if width + bits > 63:
        at = np.argsort(keys, kind="stable")
        return keys[at], at
    # A sort of numbers is several times faster than one of places.
    both = np.sort(keys << bits | np.arange(len(keys)))
    return both >> bits, both & ((1 << bits) - 1)


def _suffix_order(text: np.ndarray, to_end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and where in it each class of ``depth`` equal symbols starts.

    ``text``: symbols from 1, and a 0 behind each string, which sorts before all
    symbols, in the strings' order; ``to_end``: how far it is to that.  Each round
    sorts only the places that symbols so far leave equal, by twice as many symbols.
    """
    n, bits = len(text), len(text).bit_length()
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = min(4, depth)
    keys = text.copy()
    for k in range(1, known):
        keys <<= 9
        keys[: n - k] |= np.where(to_end[: n - k] >= k, text[k:], 0)
    keys, order = _sorted_places(keys, 9 * known)
    new = np.append(True, keys[1:] != keys[:-1]) | (to_end[order] < known)
    slots, rank, starts = np.arange(n), np.empty(n, np.int64), None
    while True:
        # The rank of a place is the first slot of those it is equal to.
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(new)))
        rank[order[slots]] = np.repeat(slots[first], counts)
        if known == depth:
            starts = np.flatnonzero(rank[order] == np.arange(n))
        slots = slots[np.repeat(counts > 1, counts)]
        if not len(slots) and known >= depth:
            return order, starts
        step = min(known, depth - known) if known < depth else known
        known += step
        places = order[slots]
        keys, at = _sorted_places(rank[places] << bits | rank[places + step], 2 * bits)
        order[slots] = places[at]
        new = np.append(True, keys[1:] != keys[:-1])[: len(slots)]


class RunLengthIndex:
    """Run-compressed BWT of strings, each closed by a separator of its own, with the least owner of each class of rows.

    Kept: run heads and starts with per-symbol ranks, the text position at each
    run's end, and per class of rows that share ``depth`` symbols the least owner.
    The suffix array itself is dropped.
    """

    def __init__(self, strings: Sequence[bytes], owners: np.ndarray, depth: int):
        self.depth, self.sizes = depth, np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(self.sizes + 1) - 1
        n = self.n = int(ends[-1]) + 1 if len(strings) else 0
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        owner = np.repeat(owners, self.sizes + 1)
        to_end = np.repeat(ends, self.sizes + 1) - np.arange(n)
        order, by_depth = _suffix_order(text, to_end, depth)
        bwt = text[order - 1]
        change = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1])) if n else np.zeros(0, np.int64)
        lengths = np.diff(np.append(change, n))
        heads = bwt[change]
        self.run_end_samples = order[change + lengths - 1] if n else order
        by_symbol = np.lexsort((change, heads))
        self.heads, self.starts, lens = heads[by_symbol], change[by_symbol], lengths[by_symbol]
        self.keys, self.lens = self.heads * (n + 1) + self.starts, lens
        self.before = np.cumsum(lens) - lens
        self.first_of = np.zeros(259, np.int64)
        totals = np.bincount(heads, lengths, 258).astype(np.int64) if n else np.zeros(258, np.int64)
        self.first_of[1:] = np.cumsum(totals)
        self.symbol_base = self.before[np.minimum(np.searchsorted(self.heads, np.arange(259)), max(0, len(heads) - 1))] if n else np.zeros(259, np.int64)
        self.class_starts = by_depth
        self.class_least = np.minimum.reduceat(owner[order], self.class_starts) if n else np.zeros(0, np.int64)
        self.least = np.repeat(self.class_least, np.diff(np.append(by_depth, n)))

    def lf(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Row of symbol + suffix for rows of suffixes, from the runs alone."""
        k = np.searchsorted(self.keys, symbols * (self.n + 1) + rows, side="right") - 1
        rank = self.before[k] - self.symbol_base[symbols] + np.minimum(rows - self.starts[k], self.lens[k])
        return self.first_of[symbols] + rank

    def stream(self, strings: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(string numbers, places, least owners of the class) for each place with ``depth`` symbols to its right.

        All indexed strings walk backwards together, one LF step at a time,
        from the rows of their separators, which are the first rows of all.
        """
        flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        begins = np.cumsum(self.sizes) - self.sizes
        live = np.argsort(-self.sizes, kind="stable")
        rows = live.astype(np.int64)
        sizes = self.sizes[live]
        for back in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            on = int(np.searchsorted(-sizes, -back, side="right"))
            live, rows, sizes = live[:on], rows[:on], sizes[:on]
            rows = self.lf(rows, flat[begins[live] + sizes - back])
            if back >= self.depth:
                yield live, sizes - back, self.least[rows]


#: ``chash`` and ``check`` are two unlike 64-bit hashes of the bytes; pieces are equal where both are.
PIECE = np.dtype([("chash", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("start", "<u8"), ("size", "<u4")])


def _pack(rows: np.ndarray) -> bytes:
    """The rows byte by byte of the record, so that the high bytes of small numbers compress."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes()


def _unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, U)
    if n > 1:
        out[1:] = U(base)
        np.multiply.accumulate(out, out=out)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Anchors:
    """Least grams of all windows of some texts laid end to end."""

    def __init__(self, length: int, cuts_only: bool = False):
        """``cuts_only``: texts are only cut into pieces, no least grams are found."""
        self.length, self.cuts_only = length, cuts_only
        self.up = self.down = np.zeros(0, U)

    def of(self, texts: list[bytes]) -> None:
        self.raw = b"".join(texts)
        n = len(self.raw)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        if n + 1 > len(self.up):
            self.up, self.down = _powers(n + 1, BASE), _powers(n + 1, BASE_INVERSE)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((np.frombuffer(self.raw, np.uint8).astype(U) + U(1)) * self.up[:n], out=self.sums[1:])
        w = self.length - GRAM + 1
        self.cuts = np.zeros(0, np.int64)
        if n < self.length:
            self.least, self.valid, self.doc = np.zeros(0, U), np.zeros(0, bool), np.zeros(0, np.int64)
            return
        least = _mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: n - GRAM + 1])
        self.cuts = np.flatnonzero((least & U(127)) == U(0))
        if self.cuts_only:
            return
        span = 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        self.least = least
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)[: len(least)]
        self.valid = np.arange(len(least)) + self.length <= self.ends[self.doc]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each maximal run of windows of one text with one anchor."""
        v = np.flatnonzero(self.valid)
        if not len(v):
            return v, v
        new = np.append(True, (v[1:] != v[:-1] + 1) | (self.least[v[1:]] != self.least[v[:-1]]) | (self.doc[v[1:]] != self.doc[v[:-1]]))
        at = np.flatnonzero(new)
        return v[at], v[np.append(at[1:] - 1, len(v) - 1)]


    def pieces(self, others: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """PIECE rows, and the first and last window of each; pieces without a window are left out."""
        starts = self.ends - self.sizes
        begin = np.unique(np.concatenate([starts[self.sizes > 0], self.cuts]))
        doc = np.searchsorted(self.ends, begin, side="right")
        stop = np.minimum(np.append(begin[1:], len(self.raw)), self.ends[doc])
        last = np.minimum(stop, self.ends[doc] - self.length + 1) - 1
        keep = last >= begin
        begin, last, doc = begin[keep], last[keep], doc[keep]
        rows = np.empty(len(begin), PIECE)
        ids, keys = (np.array([o[c] for o in others], np.int64) for c in (0, 1))
        rows["doc"], rows["key"], rows["start"], rows["size"] = ids[doc], keys[doc], begin - starts[doc], last + self.length - begin
        rows["check"], rows["chash"] = 0, _mix((self.sums[last + self.length] - self.sums[begin]) * self.down[begin] + rows["size"].astype(U))
        return rows, begin, last

    def only(self, others: list, first: Marks) -> None:
        """Leave the windows of pieces that are marked as the first of their kind."""
        rows, begin, last = self.pieces(others)
        on = first.has(rows["chash"], rows["doc"])
        step = np.zeros(len(self.least) + 1, np.int64)
        np.add.at(step, begin[on], 1)
        np.add.at(step, last[on] + 1, -1)
        self.valid &= np.cumsum(step[:-1]) > 0


class Marks:
    """A bitmap of (hash, document) pairs, cut into ranges of the hash's first ``deal`` bits; no false negatives."""

    def __init__(self, bits: bytes | np.ndarray, deal: int):
        self.bits, self.deal = bits, deal

    @staticmethod
    def places(chash: np.ndarray, doc: np.ndarray, deal: int, bits: int) -> np.ndarray:
        part = U(bits >> deal)
        return (chash >> U(64 - deal)) * part + _mix(chash ^ (doc.astype(np.int64).view(U) * U(BASE))) % part

    def has(self, chash: np.ndarray, doc: np.ndarray) -> np.ndarray:
        at = self.places(chash, doc, self.deal, len(self.bits) * 8).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _set_bits(n_bits: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n_bits // 8, np.uint8)
    at = at.astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def settle_pieces(base: DataFrame, length: int, deal: int, bits: int, buckets: int) -> DataFrame:
    """(top, bits, bucket, blob): per range of piece hashes the marks of first pieces, and the ranges of the others by row bucket."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, size = Anchors(length, cuts_only=True), [], 0
        for texts, others in _texts(batches):
            anchors.of(texts)
            rows, begin, last = anchors.pieces(others)
            raw = memoryview(anchors.raw)
            rows["check"] = np.fromiter((xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(begin.tolist(), (last + length).tolist(), strict=True)), U, len(rows))
            held.append(rows)
            size += len(raw)
            if size >= DEALT:
                yield flush(held)
                size = 0
        if held:
            yield flush(held)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        held.clear()
        return _deal(rows["chash"] >> U(64 - deal), rows, None, None)

    def meet(t: pa.Table) -> pa.Table:
        top = t.column("bucket")[0].as_py()
        rows = np.concatenate([_unpack(x, PIECE) for x in t.column("blob").to_pylist()])
        done, first, _ = _settle(rows, rows["check"])
        part = bits >> deal
        marks = _set_bits(part, Marks.places(first["chash"], first["doc"], deal, bits) - U(top * part))
        dealt = _deal(_place(_mix(done["key"].view(U)), buckets), done, None, None)
        n = dealt.num_rows
        return pa.table({
            "top": pa.array([top] * (n + 1), pa.int64()), "bits": pa.array([marks.tobytes()] + [None] * n, pa.binary()),
            "bucket": pa.array([None, *dealt.column(0).to_pylist()], pa.int64()), "blob": pa.array([None, *dealt.column(1).to_pylist()], pa.binary()),
        })

    posted = base.select("_b", "_order", "_key").mapInArrow(post, "bucket long, blob binary")
    return posted.groupBy("bucket").applyInArrow(meet, "top long, bits binary, bucket long, blob binary")


def _texts(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[list[bytes], list]]:
    """Texts (first column) and their rows' other columns, about ``most`` bytes at a time."""
    texts, others, size = [], [], 0
    for b in batches:
        rest = list(zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)) if b.num_columns > 1 else [()] * b.num_rows
        for i in range(b.num_rows):
            t = b.column(0)[i].as_py()
            texts.append(t)
            others.append(rest[i])
            size += len(t)
            if size >= most:
                yield texts, others
                texts, others, size = [], [], 0
    if texts:
        yield texts, others


#: ``anchor`` is a part of the anchor's hash: strings that differ in it share no window.
SEGMENT = np.dtype([("anchor", "<u4"), ("doc", "<i8"), ("key", "<i8"), ("start", "<u8"), ("size", "<u4")])
COVER = np.dtype([("key", "<i8"), ("start", "<i8"), ("size", "<i8")])


def _deal(names: np.ndarray, rows: np.ndarray, texts: np.ndarray | None, sizes: np.ndarray | None) -> pa.RecordBatch:
    # Sixteen-bit keys are sorted by radix.
    order = np.argsort(names.astype(np.uint16) if len(names) and int(names.max()) < 1 << 16 else names, kind="stable")
    names, rows = names[order], rows[order]
    which, begins = np.unique(names, return_index=True)
    ends = np.append(begins[1:], len(names))[: len(begins)]
    columns, titles = [pa.array(which.astype(np.int64)), pa.array([_pack(rows[i:j]) for i, j in zip(begins, ends, strict=True)], pa.binary())], ["bucket", "blob"]
    if texts is not None:
        columns.append(pa.array([b"".join(texts[order[i:j]]) for i, j in zip(begins, ends, strict=True)], pa.binary()))
        titles.append("text")
    return pa.RecordBatch.from_arrays(columns, names=titles)


def _place(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> U(32)) * U(n) >> U(32)


def repeated_anchors(base: DataFrame, length: int, deal: int, bits: int, first_pieces) -> np.ndarray:
    """Bitmap (``bits`` bits, by the hash's first bits) of the anchors that two rows have.

    Anchors are dealt by their first ``deal`` bits (16 at most), so each bucket
    makes its own piece of the bitmap.
    """
    shift = U(64 - (bits.bit_length() - 1))
    first_bits, rest, buckets = U(64 - deal), U(24 - deal), 1 << deal

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, size = Anchors(length), [], 0
        for texts, others in _texts(batches):
            anchors.of(texts)
            anchors.only(others, first_pieces.value)
            first, _ = anchors.runs()
            h = anchors.least[first]
            # Once per row: equal (row, anchor) pairs have equal mixed keys.
            key = h ^ _mix(anchors.doc[first].astype(U) + U(1))
            order = np.argsort(key)
            key = key[order]
            h = h[order[np.append(True, key[1:] != key[:-1])]] if len(key) else h
            held.append(h)
            size += len(h)
            if size > 400_000:
                yield flush(held)
                size = 0
        if size:
            yield flush(held)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(held)
        held.clear()
        # 40 bits after the bucket's are enough; an accidental repeat only costs time.
        packed = np.ascontiguousarray(((h << U(deal)) >> U(24)).view(np.uint8).reshape(-1, 8)[:, :5])
        return _deal(h >> first_bits, packed.view("V5").reshape(-1), None, None)

    def meet(t: pa.Table) -> pa.Table:
        top = t.column("bucket")[0].as_py()
        raw = np.concatenate([np.frombuffer(x, np.uint8).reshape(5, -1).T for x in t.column("blob").to_pylist()])
        h = np.zeros((len(raw), 8), np.uint8)
        h[:, :5] = raw
        h = np.sort(h.reshape(-1).view("<u8"))
        twice = np.unique(h[1:][h[1:] == h[:-1]])
        where = ((U(top) << first_bits) | (twice << rest)) >> shift
        part = bits // buckets
        bytes_of = _set_bits(part, where - U(top * part))
        return pa.table({"bucket": pa.array([top], pa.int64()), "bits": pa.array([bytes_of.tobytes()], pa.binary())})

    made = base.select("_b", "_order", "_key").mapInArrow(post, "bucket long, blob binary").groupBy("bucket").applyInArrow(meet, "bucket long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    # bits / 8 bytes in all, whatever the corpus.
    with shuffles_freed(base.sparkSession):
        pieces = made.select("*").collect()
    for r in pieces:
        piece = np.frombuffer(r["bits"], np.uint8)
        out[r["bucket"] * len(piece) : (r["bucket"] + 1) * len(piece)] = piece
    return out


def covered(base: DataFrame, length: int, bitmap, buckets: int, bits: int, first_pieces) -> DataFrame:
    """(bucket, blob) of the byte ranges of rows whose windows also start in a smaller document."""
    shift = U(64 - (bits.bit_length() - 1))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, strings, size = Anchors(length), [], [], 0
        for texts, others in _texts(batches):
            anchors.of(texts)
            anchors.only(others, first_pieces.value)
            first, last = anchors.runs()
            h = anchors.least[first]
            at = (h >> shift).astype(np.int64)
            often = (bitmap.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            first, last, h = first[often], last[often], h[often]
            ids = np.array([o[0] for o in others], np.int64)
            keys = np.array([o[1] for o in others], np.int64)
            doc = anchors.doc[first]
            stop = last + length
            rows = np.empty(len(first), SEGMENT)
            rows["anchor"], rows["doc"], rows["key"] = (h & U(0xFFFFFFFF)).astype(np.uint32), ids[doc], keys[doc]
            rows["size"], rows["start"] = stop - first, first - (anchors.ends[doc] - anchors.sizes[doc])
            held.append((rows, h))
            strings += [anchors.raw[i:j] for i, j in zip(first.tolist(), stop.tolist(), strict=True)]
            size += len(anchors.raw)
            if size >= DEALT:
                yield from flush(held, strings)
                size = 0
        if held:
            yield from flush(held, strings)

    def flush(held: list[tuple[np.ndarray, np.ndarray]], strings: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows, h = (np.concatenate(x) for x in zip(*held, strict=True))
        done, rows, keep = _settle(rows, _same(strings))
        if len(done):
            dealt = _deal(_place(_mix(done["key"].view(U)), buckets), done, None, None)
            yield pa.RecordBatch.from_arrays([*dealt.columns, pa.nulls(dealt.num_rows, pa.binary())], names=["bucket", "blob", "text"])
        yield _deal(_place(h[keep], buckets), rows, np.array([strings[i] for i in keep] + [b""], object)[:-1], rows["size"])
        held.clear()
        strings.clear()

    def meet(t: pa.Table) -> pa.Table:
        out, rows, texts = [], [], []
        for blob, text in zip(t.column("blob").to_pylist(), t.column("text").to_pylist(), strict=True):
            if text is None:
                out.append(_unpack(blob, COVER))
            else:
                rows.append(_unpack(blob, SEGMENT))
                texts.append(text)
        if rows:
            found = np.concatenate(rows)
            raw, stops = b"".join(texts), np.cumsum(found["size"].astype(np.int64))
            begins = stops - found["size"]
            same = _same([raw[i:j] for i, j in zip(begins.tolist(), stops.tolist(), strict=True)])
            done, found, keep = _settle(found, same)
            out.append(done)
            begins, stops, same = begins[keep], stops[keep], same[keep]
            one = np.unique(same, return_index=True)[1]
            # Strings alone with their anchor match no other.
            anchors, many = np.unique(found["anchor"][one], return_counts=True)
            one = one[np.isin(found["anchor"][one], anchors[many > 1])]
            which, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in _parts(found["anchor"][one], found["size"][one]):
                strings, owners = [raw[begins[i] : stops[i]] for i in one[part]], found["doc"][one[part]]
                for numbers, at, least in RunLengthIndex(strings, owners, length).stream(strings):
                    hit = least < owners[numbers]
                    which.append(part[numbers[hit]])
                    places.append(at[hit])
            which, places = np.concatenate(which), np.concatenate(places)
            order = np.lexsort((places, which))
            which, places = which[order], places[order]
            if len(which):
                begin = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (places[1:] != places[:-1] + 1)))
                end = np.append(begin[1:] - 1, len(which) - 1)
                number = same[one][which[begin]]
                size = places[end] + length - places[begin]
                # Each row that holds the string gets its ranges.
                order = np.argsort(same, kind="stable")
                lo = np.searchsorted(same[order], number, side="left")
                hi = np.searchsorted(same[order], number, side="right")
                times = hi - lo
                at = order[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
                more = np.empty(len(at), COVER)
                more["key"], more["start"], more["size"] = found["key"][at], found["start"][at].astype(np.int64) + np.repeat(places[begin], times), np.repeat(size, times)
                out.append(more)
        every = np.concatenate([*out, np.zeros(0, COVER)])
        return pa.Table.from_batches([_deal(_place(_mix(every["key"].view(U)), buckets), every, None, None)])

    posted = base.select("_b", "_order", "_key").mapInArrow(post, "bucket long, blob binary, text binary")
    return posted.groupBy("bucket").applyInArrow(meet, "bucket long, blob binary")


def _parts(anchors: np.ndarray, sizes: np.ndarray, most: int = INDEXED) -> Iterator[np.ndarray]:
    """Places of whole anchors' strings, about ``most`` bytes at a time, those with long strings together."""
    if not len(anchors):
        return
    names, group = np.unique(anchors, return_inverse=True)
    longest, total = np.zeros(len(names), np.int64), np.bincount(group, sizes).astype(np.int64)
    np.maximum.at(longest, group, sizes)
    by_length = np.argsort(longest, kind="stable")
    number = np.empty(len(names), np.int64)
    number[by_length] = (np.cumsum(total[by_length]) - total[by_length]) // most
    number = number[group]
    order = np.argsort(number, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(number[order])) + 1)


def _same(strings: list[bytes]) -> np.ndarray:
    """A number for each string, the same for equal bytes."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(s, len(numbers)) for s in strings), np.int64, len(strings))


def _settle(rows: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose whole string a smaller document has, as ranges; the other rows; their places.

    Strings are equal where ``same`` is, and ``chash`` if rows have one.
    """
    chash = rows["chash"] if "chash" in rows.dtype.names else same
    order = np.lexsort((rows["doc"], same, chash))
    chash, same, doc = chash[order], same[order], rows["doc"][order]
    new = np.append(True, (chash[1:] != chash[:-1]) | (same[1:] != same[:-1])) if len(rows) else np.zeros(0, bool)
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(rows) else doc
    later = doc > least
    gone = rows[order[later]]
    done = np.empty(len(gone), COVER)
    done["key"], done["start"], done["size"] = gone["key"], gone["start"], gone["size"]
    keep = np.sort(order[~later])
    return done, rows[keep], keep


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, most_bits: int = 1 << 30, bucket_bytes: int = 1 << 20
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    Every byte is removed that a ``length``-byte string covers which also starts
    in a document with a smaller id; strings are judged on the input.  Null text
    is empty.  A null id counts as the smallest.  Rows with one id are no smaller
    than each other, so repeated rows keep what they share.  Matches never cross
    rows.  Other columns are ignored; an empty table gives no rows.
    """
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_order"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_b"),
    ).withColumn("_key", F.xxhash64("_id", "_b"))
    volume = base.agg(F.sum(F.octet_length("_b"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(volume) // bucket_bytes)
    # About one anchor in ten bytes: a bit or more for each, up to most_bits (128 MB), and half a million a bucket.
    bits = 1 << min(most_bits.bit_length() - 1, max(20, (int(volume) // 8).bit_length()))
    deal = min(16, max(6, (int(volume) // 5_000_000).bit_length()))
    settled = cut(settle_pieces(base, length, deal, bits, buckets))
    marks = np.zeros(bits // 8, np.uint8)
    for r in settled.where("bits IS NOT NULL").select("top", "bits").collect():
        piece = np.frombuffer(r["bits"], np.uint8)
        marks[r["top"] * len(piece) : (r["top"] + 1) * len(piece)] = piece
    first_pieces = spark.sparkContext.broadcast(Marks(marks, deal))
    bitmap = spark.sparkContext.broadcast(repeated_anchors(base, length, deal, bits, first_pieces))

    def merge(t: pa.Table) -> pa.Table:
        rows = np.concatenate([_unpack(x, COVER) for x in t.column("blob").to_pylist()])
        rows = rows[np.lexsort((rows["start"], rows["key"]))]
        if not len(rows):
            return pa.table({"_k": pa.array([], pa.int64()), "_ranges": pa.array([], pa.binary())})
        keys, begins = np.unique(rows["key"], return_index=True)
        number = np.repeat(np.arange(len(keys)), np.diff(np.append(begins, len(rows))))
        far = int((rows["start"] + rows["size"]).max()) + 1
        lo, hi = rows["start"] + number * far, np.maximum.accumulate(rows["start"] + rows["size"] + number * far)
        new = np.append(True, lo[1:] > hi[:-1])
        at = np.flatnonzero(new)
        ranges = np.stack([lo[at] % far, hi[np.append(at[1:] - 1, len(lo) - 1)] - number[at] * far], axis=1).astype("<i8")
        edge = np.searchsorted(number[at], np.arange(len(keys) + 1))
        return pa.table({"_k": pa.array(keys), "_ranges": pa.array([ranges[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    whole_pieces = settled.where("blob IS NOT NULL").select("bucket", "blob")
    ranges = cut(covered(base, length, bitmap, buckets, bits, first_pieces).unionByName(whole_pieces).groupBy("bucket").applyInArrow(merge, "_k long, _ranges binary"))
    own_bits = 1 << 23
    marked = flag_in_bitmap(base, "_key", bitmap_of(ranges, "_k", own_bits), own_bits, "_in")
    kind = base.schema["_id"].dataType.simpleString()

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, cuts = b.column(1)[i].as_py(), np.frombuffer(b.column(2)[i].as_py() or b"", "<i8").reshape(-1, 2)
                at, kept = 0, []
                for lo, hi in cuts:
                    kept.append(text[at:lo])
                    at = hi
                left = b"".join([*kept, text[at:]])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), pa.array([len(text)]), pa.array([len(text) - len(left)]), pa.array([len(cuts)]), pa.array([left], pa.binary()), pa.array([hashlib.sha256(left).hexdigest()])],
                    names=["_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    schema = f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    struck = marked.where("_in").join(ranges, F.col("_key") == F.col("_k"), "left").select("_id", "_b", "_ranges").mapInArrow(strike, schema)
    whole = marked.where("NOT _in").select("_id", F.octet_length("_b").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("_b").alias("kept"), F.sha2("_b", 256).alias("kept_sha256"))
    return struck.unionByName(whole).withColumnRenamed("_id", id_col)
