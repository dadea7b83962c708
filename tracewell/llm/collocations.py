"""Phrase collocation mining over depth-limited count tries.

Each shard, a block of texts, counts phrases in a trie: a node of depth d is a
node of depth d - 1 and one word more.  The trie is serialised in the order of
its paths, which begin with the language, as blocks of neighbouring paths.  One
path drawn from each block shows how paths are spread; ranges of the path order
are cut from them and dealt to tasks, where the shards' sorted runs of a range
are merged and equal paths summed.  What a task holds at once are a shard, a few
MB of blocks, or the different paths of a range, whatever the size of the corpus.

Depths are worked off in three rounds: words, pairs of words, and all longer
phrases at once.  What was rare in a round cannot be part of a frequent phrase,
so the next round leaves it out.  The frequent ones are told by a bitmap of
fixed size without false negatives, so that it only spares work and counts stay
exact.  Frequent nodes then take the counts of the left parts from their parents
in the trie, of the right parts along suffix links (the path without its first
word), depth by depth.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BITMAP_ROW_BITS, bitmap_of, cut, drop_path, new_path, shuffles_freed, text_or_empty

#: Bytes that part words, and bytes that end a piece of text.
BLANKS, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
KINDS = bytes(1 if b in BLANKS else 2 if b in ENDS else 0 for b in range(256))
#: Parts the language from the words of a path; no word holds it.
UNDER = b"\n"
#: Bytes of text in one trie, paths of one serialised block, paths of a range (before equal ones are summed).
SHARD, PATHS, RANGE = 3 << 20, 4096, 300_000
#: Drawn paths from which ranges are chosen, at most, and most ranges of one round.
HEADS, RANGES = 100_000, 50_000
#: Bytes of slices that are sent at once, and nodes that are made into rows at once.
SENT, ROWS = 1 << 20, 10_000
#: Spark's settings while tries are counted and merged. A block has 100 KB and more, so batches of Spark's own
#: numbers of rows, and row groups of Parquet's own size, would be held by the hundred MB in each task.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "64"}
ROW_GROUP = 16 << 20
BLOCK = "drawn binary, paths binary, lengths binary, counts binary"
SLICE = "range int, paths binary, lengths binary, counts binary"
NODES = "lang binary, path binary, depth int, n long"


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Word numbers, their words, and each word's piece and text, over the binary array ``texts`` without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, count=len(texts) + 1, offset=4 * texts.offset)
    data = bytes(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].translate(LOWER) if len(texts) else b""
    kinds = np.frombuffer(data.translate(KINDS), np.uint8)
    size = len(kinds)
    opens = np.zeros(size + 1, bool)
    opens[offsets - offsets[0]] = True
    inside = kinds == 0
    edge = np.concatenate([[True], ~inside])[:size] if size else np.zeros(0, bool)
    begins = np.flatnonzero(inside & (edge | opens[:size]))
    edge = np.concatenate([~inside[1:], [True]]) if size else np.zeros(0, bool)
    lengths = np.flatnonzero(inside & (edge | opens[1:])) + 1 - begins
    piece = np.cumsum((kinds == 2) | opens[:size], dtype=np.int32)[begins]
    text = np.searchsorted(offsets - offsets[0], begins, side="right") - 1
    kept = np.frombuffer(data, np.uint8)[inside]
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(kept)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, piece, text


class Likely:
    """Paths that may be frequent: a bitmap by their crc32."""

    def __init__(self, bits: int, rows: list):
        self.bits, self.map = bits, np.zeros(max(bits // 8, BITMAP_ROW_BITS // 8), np.uint8)
        for r in rows:
            at = r["bm_bucket"] * (BITMAP_ROW_BITS // 8)
            self.map[at : at + BITMAP_ROW_BITS // 8] = np.frombuffer(r["bm"], np.uint8)

    def __call__(self, paths: pa.Array) -> np.ndarray:
        at = np.fromiter(map(zlib.crc32, paths.to_pylist()), np.int64, len(paths)) % self.bits
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def likely(frequent: DataFrame, bits: int):
    """A broadcast ``Likely`` of ``bits`` bits, whatever the number of frequent paths."""
    hashed = frequent.select(F.crc32(F.concat("lang", F.lit(UNDER), "path")).alias("_h"))
    # Hashes are dealt by their row of the bitmap; else each task would send a row of its own for every one, which compress well but are sorted in full.
    hashed = hashed.repartition(F.floor(F.pmod("_h", F.lit(bits)) / BITMAP_ROW_BITS).cast("int"))
    return frequent.sparkSession.sparkContext.broadcast(Likely(bits, bitmap_of(hashed, "_h", bits).collect()))


def in_order(codes: np.ndarray, values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``codes`` and ``values`` with the values, which differ, in the order of their bytes."""
    order = pc.sort_indices(values)
    rank = np.empty(len(values), np.int64)
    rank[order.to_numpy()] = np.arange(len(values))
    return rank[codes], values.take(order)


def above_blank(values: pa.Array) -> bool:
    """Whether all bytes are greater than what joins words and languages."""
    return bool(np.frombuffer(packed(values)[0], np.uint8).min(initial=255) > max(UNDER + b" "))


class Trie:
    """Counts of one shard at one depth, each node known by its path.

    ``at``: where in the word sequence a phrase begins; ``node``: its node.
    ``ordered``: whether nodes are in the order of their paths.  They are in that
    of their languages' and words' bytes, which is the same but for odd bytes.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array):
        word, names, self.piece, text = words_of(texts)
        self.word, self.names = in_order(word, names)
        coded = langs.dictionary_encode()
        lang, named = in_order(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)
        self.ordered = above_blank(named) and above_blank(self.names)
        self.depth, self.at = 1, np.arange(len(self.word))
        self._grow(lang[text], self.word, named, UNDER)

    def _grow(self, parent: np.ndarray, word: np.ndarray, paths: pa.Array, joint: bytes) -> None:
        size = max(len(self.names), 1)
        keys, self.node, self.counts = np.unique(parent * size + word, return_inverse=True, return_counts=True)
        self.paths = pc.binary_join_element_wise(paths.take(pa.array(keys // size)), self.names.take(pa.array(keys % size)), joint)

    def deepen(self, keep: np.ndarray | None) -> None:
        """Go one word deeper; a phrase goes on only where its first and its last part, of this depth, are of nodes to ``keep``."""
        if keep is not None:
            chosen = keep[self.node]
            self.at, self.node = self.at[chosen], self.node[chosen]
        # Both the phrase that begins here and the one that begins a word later are left, and lie in one piece.
        pair = np.flatnonzero(self.at[1:] == self.at[:-1] + 1)
        last = self.at[pair] + self.depth
        inside = self.piece[self.at[pair]] == self.piece[last]
        pair, last = pair[inside], last[inside]
        self.at = self.at[pair]
        self._grow(self.node[pair], self.word[last], self.paths, b" ")
        self.depth += 1


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, languages) of about ``most`` bytes of whole texts."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        begin = 0
        for end, s in enumerate(sizes.tolist(), 1):
            size += s
            if size >= most:
                held.append(batch.slice(begin, end - begin))
                yield _joined(held)
                held, size, begin = [], 0, end
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.concat_arrays([b.column(c) for b in batches]) for c in ("text", "lang"))


def packed(paths: pa.Array) -> tuple[bytes, bytes]:
    """The bytes of binary ``paths``, and their lengths."""
    offsets = np.frombuffer(paths.buffers()[1], np.int32, count=len(paths) + 1, offset=4 * paths.offset)
    return bytes(memoryview(paths.buffers()[2] or b"")[offsets[0] : offsets[-1]]), np.diff(offsets).astype("<i4").tobytes()


def unpacked(paths: bytes, lengths: bytes) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<i4"))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(paths)])


def rows_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def serialised(paths: pa.Array, counts: np.ndarray, ordered: bool, size: int) -> Iterator[pa.RecordBatch]:
    """A shard's nodes of one depth in the order of their paths, in blocks, each with a path drawn from it."""
    if not ordered:
        order = pc.sort_indices(paths)
        paths, counts = paths.take(order), counts[order.to_numpy()]
    for begin in range(0, len(paths), size):
        block = paths.slice(begin, size)
        names, lengths = packed(block)
        drawn = block[zlib.crc32(names) % len(block)].as_py()
        yield rows_batch([(drawn, names, lengths, counts[begin : begin + size].astype("<i8").tobytes())], ["drawn", "paths", "lengths", "counts"], [pa.binary()] * 4)


def counted(texts: DataFrame, depths: tuple[int, int], known) -> DataFrame:
    """Sorted runs of blocks: every shard's counts of phrases of the depths asked for.

    ``known``: broadcast bitmap of the frequent paths shorter than the first depth.
    """
    (first, last), shard, size = depths, SHARD, PATHS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, lang in shards(batches, shard):
            trie = Trie(text, lang)
            while True:
                if trie.depth >= first:
                    yield from serialised(trie.paths, trie.counts, trie.ordered, size)
                if trie.depth >= last or not len(trie.node):
                    break
                trie.deepen(known.value(trie.paths) if trie.depth < first else None)
            del trie  # before the next one is made

    return texts.mapInArrow(run, BLOCK)


def range_bounds(runs: DataFrame) -> list[bytes]:
    """Paths at which ranges of about ``RANGE`` paths end, from the drawn paths of blocks (of ``HEADS`` of them at most)."""
    blocks, paths = runs.agg(F.count(F.lit(1)), F.sum(F.octet_length("lengths") / 4)).first()
    ranges = min(RANGES, -(-int(paths or 0) // RANGE))
    if ranges < 2:
        return []
    heads = runs.select("drawn") if blocks <= HEADS else runs.select("drawn").sample(HEADS / blocks / 1.1, seed=1)
    found = sorted(bytes(r["drawn"]) for r in heads.collect())
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)})


def merged(runs: DataFrame, least: int, totals: bool) -> DataFrame:
    """Equal paths of all runs summed: (lang, path, depth, n) of those with at least ``least``.

    Runs are cut at the bounds of ranges, ranges dealt to tasks, and the sorted
    parts of a range merged as they come: a task holds the different paths of one
    range and a buffer.  ``totals``: also rows of depth 0 with the sums of all
    paths of a language within a range.
    """
    bounds, most, sent, rows_at_once = range_bounds(runs), RANGE, SENT, ROWS

    def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> pa.RecordBatch:
            return rows_batch(rows, ["range", "paths", "lengths", "counts"], [pa.int32()] + [pa.binary()] * 3)

        rows, held = [], 0
        for batch in batches:
            for names, lengths, counts in ([batch.column(c)[j].as_py() for c in ("paths", "lengths", "counts")] for j in range(batch.num_rows)):
                paths, size = unpacked(names, lengths), len(lengths) // 4
                begin, k = 0, bisect_right(bounds, paths[0].as_py())
                while begin < size:
                    end = size if k == len(bounds) else bisect_left(range(size), bounds[k], lo=begin, key=lambda i: paths[i].as_py())
                    if end > begin:
                        rows.append((k, *packed(paths.slice(begin, end - begin)), counts[8 * begin : 8 * end]))
                    begin, k = end, k + 1
                held += len(names) + len(lengths) + len(counts)
                if held >= sent:
                    yield slices()
                    rows, held = [], 0
        if rows:
            yield slices()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def fold() -> None:
            paths, counts = pa.concat_arrays([p for p, _ in held]), np.concatenate([c for _, c in held])
            order = pc.sort_indices(paths)
            paths, counts = paths.take(order), counts[order.to_numpy()]
            begins = np.concatenate([[0], np.flatnonzero(pc.not_equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False)) + 1])
            held[:] = [(paths.take(pa.array(begins)), np.add.reduceat(counts, begins))]

        def nodes(rows: list[tuple]) -> pa.RecordBatch:
            return rows_batch(rows, ["lang", "path", "depth", "n"], [pa.binary(), pa.binary(), pa.int32(), pa.int64()])

        def close() -> Iterator[pa.RecordBatch]:
            fold()
            paths, counts = held.pop()
            if totals:
                sums: dict[bytes, int] = {}
                for begin in range(0, len(paths), rows_at_once):
                    for p, n in zip(paths.slice(begin, rows_at_once).to_pylist(), counts[begin : begin + rows_at_once].tolist(), strict=True):
                        lang = p[: p.rindex(UNDER)]
                        sums[lang] = sums.get(lang, 0) + n
                yield nodes([(lang, b"", 0, n) for lang, n in sums.items()])
            often = counts >= least
            paths, counts = paths.filter(pa.array(often)), counts[often]
            for begin in range(0, len(paths), rows_at_once):
                parted = [p.rpartition(UNDER)[::2] for p in paths.slice(begin, rows_at_once).to_pylist()]
                yield nodes([(lang, path, path.count(b" ") + 1, n) for (lang, path), n in zip(parted, counts[begin : begin + rows_at_once].tolist(), strict=True)])

        for batch in batches:
            for k, paths, lengths, counts in ([c[j].as_py() for c in batch.columns] for j in range(batch.num_rows)):
                if k != now:
                    if held:
                        yield from close()
                    now, buffered = k, 0
                held.append((unpacked(paths, lengths), np.frombuffer(counts, "<i8")))
                buffered += len(lengths) // 4
                if buffered > most:
                    fold()
                    buffered = 0
        if held:
            yield from close()

    return runs.mapInArrow(cut_runs, SLICE).repartition("range").sortWithinPartitions("range").mapInArrow(add, NODES)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs in this block is handed on a few MB at a time."""
    before = {name: spark.conf.get(name) for name in SMALL}
    try:
        for name, value in SMALL.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path."""
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.select("*").write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.parquet(path), path


def frequent_phrases(texts: DataFrame, longest: int, least: int, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of frequent nodes per depth, (lang, path, depth, n), and (lang, n) of all words."""
    found, totals, known, shorter = [], None, None, None
    for depths in [(1, 1), (2, min(2, longest)), (3, longest)]:
        if depths[0] > depths[1]:
            break
        with small_batches(texts.sparkSession):
            runs, path = written(counted(texts, depths, known), "tries")
            nodes = cut(merged(runs, least, totals is None))
        drop_path(texts.sparkSession, path)
        if totals is None:
            totals, nodes = nodes.where("depth = 0").groupBy("lang").agg(F.sum("n").alias("n")), nodes.where("depth > 0")
        found += [nodes.where(F.col("depth") == d) for d in range(depths[0], depths[1] + 1)]
        shorter = nodes if shorter is None else shorter.unionByName(nodes)
        known = likely(shorter, bits) if depths[1] < longest else None
    return found, totals


def _big(c: Column | str, digits: int = 20) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},0)")


def with_parts(levels: list[DataFrame]) -> DataFrame:
    """Frequent phrases of two and more words with ``lefts`` and ``rights``: the counts of both parts for each cut, first word first.

    Both come from one depth less: those of the parent and the parent's own count,
    and the count at the suffix link and those of the linked node.  Parts of a
    frequent phrase are frequent, so no phrase is lost.  A part that very many
    phrases share is the large side of a join that adaptive execution may split.
    """
    none = F.array().cast("array<bigint>")
    below = levels[0].select("lang", "path", "n", none.alias("lefts"), none.alias("rights"))
    made = []
    for level in levels[1:]:
        text = F.col("path").cast("string")
        here = level.select("lang", "path", "n", F.substring_index(text, " ", 1).alias("_first"), F.substring_index(text, " ", -1).alias("_last"))
        here = here.withColumn("_up", F.expr("substring(path, 1, octet_length(path) - octet_length(_last) - 1)")).withColumn("_link", F.expr("substring(path, octet_length(_first) + 2)")).drop("_first", "_last")
        up = below.select(F.col("lang").alias("_ul"), F.col("path").alias("_u"), F.concat("lefts", F.array("n")).alias("lefts"))
        link = below.select(F.col("lang").alias("_ll"), F.col("path").alias("_l"), F.concat(F.array("n"), "rights").alias("rights"))
        # Linked nodes are unique and thin: their shares are hashed instead of sorting both sides.
        joined = here.join(up.hint("shuffle_hash"), (F.col("lang") == F.col("_ul")) & (F.col("_up") == F.col("_u"))).join(link.hint("shuffle_hash"), (F.col("lang") == F.col("_ll")) & (F.col("_link") == F.col("_l")))
        below = cut(joined.select("lang", "path", "n", "lefts", "rights"))
        made.append(below)
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out


def absorbed(phrases: DataFrame, longest: int) -> DataFrame:
    """(lang, path, most): the count of the most frequent longer phrase that holds a phrase of two and more words."""
    words = F.split(F.col("path").cast("string"), " ")
    inner = [
        F.when(F.size("_w") >= start + size + (start == 0), F.array_join(F.slice("_w", start + 1, size), " ")) for size in range(2, longest) for start in range(longest - size + 1)
    ]
    if not inner:
        return phrases.where("false").select("lang", "path", F.col("n").alias("most"))
    parts = phrases.select("lang", "n", words.alias("_w")).where("size(_w) > 2").select("lang", "n", F.explode(F.array_distinct(F.array_compact(F.array(*inner))).cast("array<binary>")).alias("path"))
    return parts.groupBy("lang", "path").agg(F.max("n").alias("most"))


def top_per_language(scored: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """The first ``most`` of each language by score, count and phrase, with their rank.

    Each of ``salts`` shares of a language is cut first, so that one task never
    sees more than ``salts * most`` rows of it.
    """
    from pyspark.sql import Window

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    near = salted.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_n") <= most)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most).drop("_n", "_salt")


def mine_collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, absorb: tuple[int, int] = (80, 100), scale: int = 2_000_000, most: int = 2000, bits: int = 1 << 26
) -> DataFrame:
    """Each language's best phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased (A-Z) runs without blanks or piece ends; phrases stay
    within pieces.  ``a`` is the phrase's count, at least ``least``; for its
    weakest cut, of equal ones the first, ``l`` and ``r`` are the counts of both
    parts and ``score`` is floor(scale * a / (l + r)).  A phrase is dropped if a
    longer frequent one that holds it has at least absorb[0] / absorb[1] of its
    count.  ``n`` counts the language's words.  Null languages are ``und``, null
    texts empty; repeated rows count each; tables without frequent phrases give
    no rows.  Other columns are not read.  ``bits``: size of the bitmap by which
    rare paths are left out; results do not depend on it.
    """
    if longest < 2:
        raise ValueError("phrases have at least two words")
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    texts = docs.select(F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"))
    levels, totals = frequent_phrases(texts, longest, least, bits)
    phrases = with_parts(levels)
    share, of = absorb
    held = absorbed(phrases, longest).select(F.col("lang").alias("_hl"), F.col("path").alias("_hp"), "most")
    left = phrases.join(held, (F.col("lang") == F.col("_hl")) & (F.col("path") == F.col("_hp")), "left").where(F.col("most").isNull() | ~(_big("most") * F.lit(of) >= _big("n") * F.lit(share)))
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("lefts")),
        lambda k: F.struct(
            F.call_function("div", _big("n") * F.lit(scale).cast("decimal(12,0)"), _big(F.get("lefts", k - 1)) + _big(F.get("rights", k - 1))).alias("score"),
            k.alias("k"), F.get("lefts", k - 1).alias("l"), F.get("rights", k - 1).alias("r"),
        ),
    )
    scored = left.withColumn("_c", F.array_min(cuts)).select("lang", F.col("path").cast("string").alias("phrase"), F.col("n").alias("a"), F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), F.col("_c.score").alias("score"))
    ranked = top_per_language(scored, most)
    return ranked.join(totals.withColumnRenamed("lang", "_tl"), F.col("lang") == F.col("_tl")).select(
        F.col("lang").cast("string").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
