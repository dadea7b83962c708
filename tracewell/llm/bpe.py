"""BPE encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A word's symbols stand at the leaves; a leaf holds rank * width + place of the
pair that begins there, or ``NONE``.  Inner nodes hold the least of their
children, so the root is the leftmost pair of lowest rank.  A merge changes the
leaves of three places, and the nodes above them, until the root is ``NONE``.
Words of at most ``WIDE`` symbols are worked on many at a time as rows of a numpy
array, longer ones one by one over the same tree.

The tokenizer's file gives vocabulary, merges, normaliser and word splitting;
the last two are applied by the ``tokenizers`` library, the model is not.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a leaf or node holds where no pair can be merged.
NONE = np.iinfo(np.int64).max
#: Most symbols of a word that is worked on together with others.
WIDE = 64
#: Distinct pieces and words that a worker keeps, and bytes of text it encodes at a time.
MOST_PIECES, STEP = 200_000, 2 << 20
#: Ids that are decoded at a time.
IDS = 1 << 19
#: A splitting into words whose outcome for ASCII letters with marks behind is known, and those marks.
LETTERS_AND_MARKS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
MARKS = b",.;:!?)]}"


class SegmentTreeBpe:
    """Symbols and merges of a model; ids of words."""

    def __init__(self, model: dict):
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {odd or model.get('type')}")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.base = max(self.vocab.values(), default=0) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.base + self.vocab[b] for a, b in pairs], np.int64).reshape(-1)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64).reshape(-1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        # Of equal pairs the last one counts, as when they are put in a map.
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        last = np.append(self.keys[1:] != self.keys[:-1], True) if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks = self.keys[last], self.ranks[last]

    def symbols(self, word: str) -> list[int]:
        """Ids of a word's characters, the last one with the end mark; unknown ones are left out."""
        if not word:
            return []
        get = self.vocab.get
        found = [get(c) for c in word[:-1]]
        found.append(get(word[-1] + self.end))
        return [s for s in found if s is not None]

    def pair_leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(left.shape, NONE)
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at] * width + place, NONE)

    def encode_rows(self, words: Sequence[list[int]], width: int) -> list[bytes]:
        """Ids (int32 bytes) of many words of at most ``width`` symbols, one row of a tree each."""
        n, places = len(words), np.arange(width)
        lengths = np.fromiter(map(len, words), np.int64, n)
        sym = np.full((n, width), -1, np.int64)
        sym[places < lengths[:, None]] = np.fromiter(chain.from_iterable(words), np.int64, int(lengths.sum()))
        after = np.broadcast_to(places + 1, (n, width)).copy()
        before = np.broadcast_to(places - 1, (n, width)).copy()
        after[after >= lengths[:, None]] = -1
        tree = np.full((n, 2 * width), NONE)
        tree[:, width : 2 * width - 1] = self.pair_leaves(sym[:, :-1], sym[:, 1:], places[:-1], width)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = tree[:, 2 * level : 4 * level].reshape(n, level, 2).min(axis=2)

        def put(rows: np.ndarray, leaf: np.ndarray, values: np.ndarray) -> None:
            node = leaf + width
            tree[rows, node] = values
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            then = after[rows, gone]
            made = self.merged[rank]
            sym[rows, at], sym[rows, gone], after[rows, at] = made, -1, then
            tree[rows, gone + width] = NONE
            has = then >= 0
            before[rows[has], then[has]] = at[has]
            put(rows, gone, np.full(len(rows), NONE))
            put(rows, at, np.where(has, self.pair_leaves(made, np.where(has, sym[rows, then], -1), at, width), NONE))
            first = before[rows, at]
            has = first >= 0
            if has.any():
                r, p = rows[has], first[has]
                put(r, p, self.pair_leaves(sym[r, p], made[has], p, width))
            rows = rows[tree[rows, 1] < NONE]
        kept = sym >= 0
        flat = sym[kept].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_long(self, word: list[int]) -> list[int]:
        """Ids of one word of any length over the same tree, held in a list."""
        n = len(word)
        width = 1 << max(n - 1, 1).bit_length()
        sym, after, before = list(word), [*range(1, n), -1], list(range(-1, n - 1))
        rank_of, base, merged, none = self.rank_of, self.base, self.merged.tolist(), int(NONE)

        def leaf(a: int, b: int) -> int:
            rank = rank_of.get(sym[a] * base + sym[b])
            return none if rank is None else rank * width + a

        tree = [none] * (2 * width)
        tree[width : width + n - 1] = [leaf(i, i + 1) for i in range(n - 1)]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(place: int, value: int) -> None:
            node = place + width
            tree[node] = value
            while node > 1:
                node >>= 1
                low, high = tree[2 * node], tree[2 * node + 1]
                value = low if low < high else high
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            then = after[gone]
            sym[at], sym[gone], after[at] = merged[rank], -1, then
            put(gone, none)
            if then >= 0:
                before[then] = at
            put(at, leaf(at, then) if then >= 0 else none)
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        return [s for s in sym if s >= 0]

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """Ids (int32 bytes) of each word."""
        symbols = [self.symbols(w) for w in words]
        lengths = np.fromiter(map(len, symbols), np.int64, len(symbols))
        out = [b""] * len(words)
        for k in np.flatnonzero(lengths == 1):
            out[k] = np.array(symbols[k], np.int32).tobytes()
        for k in np.flatnonzero(lengths > WIDE):
            out[k] = np.array(self.encode_long(symbols[k]), np.int32).tobytes()
        width = 2
        while width <= WIDE:
            rows = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 2 else 1)))
            for k, ids in zip(rows, self.encode_rows([symbols[k] for k in rows], width) if len(rows) else [], strict=True):
                out[k] = ids
            width *= 2
        return out


class TextEncoder:
    """Ids of whole texts: marked tokens first, then normaliser, word splitting and ``SegmentTreeBpe``.

    Where white space only parts words, each distinct piece between ASCII white
    space is encoded once while it is kept; else each distinct word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model, library = SegmentTreeBpe(spec["model"]), Tokenizer.from_file(path)
        added = spec.get("added_tokens") or []
        if any(a.get("normalized") or a.get("single_word") or a.get("lstrip") or a.get("rstrip") for a in added):
            raise ValueError("added tokens that are normalised, whole words or stripped are not supported")
        self.added = {a["content"]: a["id"] for a in added if a["content"]}
        # The longest of those that begin at a place is taken.
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str if library.pre_tokenizer else lambda s: [(s, None)] * bool(s)
        self.parted = [w for w, _ in self.split(self.normalise("a \t\n\x0b\x0c\r b"))] == ["a", "b"] and not any(re.search(r"\s", a) for a in self.added)
        self.simple = self.parted and all(spec.get(k) == v for k, v in LETTERS_AND_MARKS.items())
        self.words: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts = self.counts = np.zeros(0, np.int64)

    def words_of(self, piece: bytes) -> list[str | int]:
        """A piece's words, and the ids of its marked tokens, in order."""
        if self.simple:
            core = piece.rstrip(MARKS)
            if core.isalpha():  # ASCII letters only
                word = core.decode().lower()
                return [word] if len(core) == len(piece) else [word, piece[len(core) :].decode()]
        text = piece.decode("utf-8", "replace")
        parts = self.marks.split(text) if self.marks else [text]
        return [w for part in parts if part for w in ([self.added[part]] if part in self.added else [w for w, _ in self.split(self.normalise(part))])]

    def pieces_ids(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of each piece, its words' ids one after the other."""
        found = [self.words_of(p) for p in pieces]
        if len(self.words) > MOST_PIECES:
            self.words.clear()
        new = list(dict.fromkeys(w for ws in found for w in ws if w.__class__ is str and w not in self.words))
        self.words.update(zip(new, self.model.encode_words(new), strict=True))
        words = self.words
        return [b"".join([w.to_bytes(4, "little") if w.__class__ is int else words[w] for w in ws]) for ws in found]

    def _learn(self, new: Sequence[bytes]) -> None:
        encoded = self.pieces_ids(new)
        counts = np.fromiter(map(len, encoded), np.int64, len(new)) // 4
        ids = np.frombuffer(b"".join(encoded), "<i4")
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.used += len(ids)

    def encode(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, one after the other, and the number of ids up to each text's end, 0 first."""
        if not self.parted:
            encoded = self.pieces_ids(texts)
            return np.frombuffer(b"".join(encoded), "<i4"), np.cumsum([0, *map(len, encoded)]) // 4
        if len(self.index) > MOST_PIECES:
            self.clear()
        index, begin, places, n_pieces = self.index, len(self.index), [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            pieces = text.split()
            places.append([index.setdefault(p, len(index)) for p in pieces])
            n_pieces[k] = len(pieces)
        if len(index) > begin:
            self._learn(list(islice(index, begin, None)))
        at = np.fromiter(chain.from_iterable(places), np.int64, int(n_pieces.sum()))
        counts = self.counts[at]
        edges = np.concatenate([[0], np.cumsum(counts)])
        source = np.repeat(self.starts[at] - edges[:-1], counts) + np.arange(edges[-1])
        return self.flat[source], edges[np.concatenate([[0], np.cumsum(n_pieces)])]


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(path: str) -> TextEncoder:
    """One per worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def encode_texts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``ids_col`` array<int>, the ids of each whole text as the tokenizer's file gives them, without added ends.

    One row per row, so equal rows stay as many as they are; null texts count as
    empty and have no ids.  No row is moved between tasks, and a worker keeps at
    most ``MOST_PIECES`` pieces.  ``keep`` must not hold ``ids_col``.
    """
    if ids_col in keep:
        raise ValueError(f"{ids_col} is among the columns to keep")
    inner = [f"_{k}" for k in range(len(keep))]
    given = docs.select(*[_column(c).alias(a) for c, a in zip(keep, inner, strict=True)], F.coalesce(_column(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    schema, names = given.drop("_text").withColumn("_ids", F.lit(None).cast("array<int>")).schema, [*inner, "_ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            sizes = pc.binary_length(batch.columns[-1]).to_numpy(zero_copy_only=False)
            step = np.cumsum(sizes, dtype=np.int64) // STEP
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    part = batch.slice(a, b - a)
                    ids, ends = encoder.encode(part.columns[-1].to_pylist())
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=names)

    return given.mapInArrow(encode, schema).toDF(*keep, ids_col)


def decode_ids(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and ``text_col``, the text of ``ids_col`` with special tokens left in.

    Ids that no token has are skipped, as are null ids; a null list counts as
    empty.  Without a decoder in the tokenizer's file tokens are joined by
    spaces; a byte-level decoder joins their bytes.
    """
    if text_col in encoded.columns:
        raise ValueError(f"there is a column {text_col} already")
    inner = encoded.toDF(*[f"_{k}" for k in range(len(encoded.columns))])
    schema = inner.select("*", F.lit(None).cast("string").alias("_text")).schema
    place, names = encoded.columns.index(ids_col), schema.names

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, join = _tokens(tokenizer_path)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.columns[place]), 0).to_numpy(zero_copy_only=False)
            step = np.cumsum(sizes, dtype=np.int64) // IDS
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*part.columns, join(_known(part.columns[place], tokens))], names=names)

    return inner.mapInArrow(decode, schema).toDF(*encoded.columns, text_col)


def _known(lists: pa.Array, tokens: pa.Array) -> pa.ListArray:
    """The tokens of lists of ids, without those that no token has."""
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    known = pc.fill_null(pc.and_kleene(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), False)
    taken, row = tokens.take(flat.filter(known)), row.filter(known)
    has = pc.is_valid(taken)
    ends = np.searchsorted(row.filter(has).to_numpy(zero_copy_only=False), np.arange(len(lists) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.filter(has))


_TOKENS: dict[str, tuple] = {}


def _tokens(path: str) -> tuple:
    """Tokens by id (null where there is none), and how lists of them become texts."""
    if path not in _TOKENS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec.get("added_tokens") or []}
        names = [by_id.get(i) for i in range(max(by_id, default=-1) + 1)]
        decoder = spec.get("decoder")
        if decoder is None:
            _TOKENS[path] = pa.array(names, pa.string()), lambda lists: pc.binary_join(lists, " ")
        elif decoder.get("type") == "ByteLevel":
            letters = byte_letters()
            spelled = [n if n is None else b"".join(letters[c] if c in letters else c.encode() for c in n) for n in names]
            text = lambda b: b.decode("utf-8", "replace")
            _TOKENS[path] = pa.array(spelled, pa.binary()), lambda lists: pa.array([text(b) for b in pc.binary_join(lists, b"").to_pylist()], pa.string())
        else:
            raise ValueError(f"decoder {decoder.get('type')} is not supported")
    return _TOKENS[path]


def byte_letters() -> dict[str, bytes]:
    """The letters by which byte-level tokenizers spell bytes: printable Latin-1 by itself, others from U+0100 on in their order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): bytes([b]) for b in plain} | {chr(0x100 + k): bytes([b]) for k, b in enumerate(other)}
