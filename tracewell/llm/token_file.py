"""Token ids in fixed-width bit-packed blocks: encode, write, read back, random access.

File format: a Parquet table with one row per block.  Columns: part (range
partition of the documents' order), block (number in the part), start (ids of
the part before the block), n_docs, n_ids, width (bits of an id), doc_ids and
id_counts (little-endian int64 and uint32, one per document), nulls (a byte per
document, 1 for a null id) and payload (the ids, ``width`` bits each, most
significant bit first, padded to whole bytes).  Blocks hold whole documents in
ascending id order, null first.  Id number i of a block begins at bit i * width, so any
document is read without its neighbours.  Writing through Spark's committer
keeps the table whole when tasks are repeated, on any store that Spark reads.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_path  # noqa: F401

#: ASCII marks that may follow a word; the apostrophe may begin a word's ending and is left out.
TAIL = ",.;:!?|&*#$%)]}"

BLOCK_SCHEMA = "part int, block int, start long, n_docs int, n_ids long, width int, doc_ids binary, nulls binary, id_counts binary, payload binary"
BLOCK_ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32())]
    + [(n, pa.binary()) for n in ("doc_ids", "nulls", "id_counts", "payload")]
)


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits of each id, one after the other."""
    if width == 16:
        return ids.astype(">u2").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits).tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids start to start + count of a block, without reading the others."""
    first = start * width
    raw = np.frombuffer(payload, np.uint8, count=(first + count * width + 7) // 8 - first // 8, offset=first // 8)
    if width == 16:
        return raw.view(">u2").astype(np.uint32)
    bits = np.unpackbits(raw)[first % 8 : first % 8 + count * width].reshape(count, width)
    out = np.zeros((count, 32), np.uint8)
    out[:, 32 - width :] = bits
    return np.packbits(out, axis=1).reshape(-1).view(">u4").astype(np.uint32)


class WordCachedEncoder:
    """Ids of whole texts from a tokenizer whose tokens never cross white space.

    White space is dropped by the tokenizer and bounds its pieces, so a text's
    ids are those of its white-space separated pieces, one after the other;
    each distinct piece is encoded once.  A-Z may be lower-cased first as the
    tokenizer does so itself, unless a text may spell a special token.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.marks: dict[str, list[int]] = {}
        # How the tokenizer spells bytes: by itself where it is printable, else by a letter of its own.
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {b: spelled.pre_tokenize_str(bytes([b]).decode("latin-1"))[0][0][-1] for b in range(0x80, 0xC0)}
        self.letters |= {b: self._lead(spelled, b) for b in range(0xC2, 0xF5)}
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.clear()

    @staticmethod
    def _lead(spelled, byte: int) -> str:
        """The letter of a lead byte, from a character that begins with it."""
        more = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
        second = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
        return spelled.pre_tokenize_str(bytes([byte, second, *[0x80] * (more - 1)]).decode())[0][0][0]

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts = self.counts = np.zeros(0, np.int64)

    def piece_ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece.

        Letters, then marks from ``TAIL``, are two words to the tokenizer, each
        of which its model can be asked for directly; other pieces take the
        whole way through it.
        """
        out: list[list[int] | None] = [None] * len(pieces)
        ask, letters, rest = self.tokenizer.model.tokenize, self.letters, []
        for k, piece in enumerate(pieces):
            text = piece.decode("utf-8", "replace")
            core = text.rstrip(TAIL)
            if core.isascii():
                plain = core.lower()
            else:
                plain = self.tokenizer.normalizer.normalize_str(core)
            if not plain.isalpha():
                rest.append(k)
                continue
            if not plain.isascii():
                plain = plain.encode().decode("latin-1").translate(letters)
            ids = [t.id for t in ask(plain)]
            mark = text[len(core) :]
            if mark:
                if mark not in self.marks:
                    self.marks[mark] = self.tokenizer.encode(mark, add_special_tokens=False).ids
                ids += self.marks[mark]
            out[k] = ids
        for k, e in zip(rest, self.tokenizer.encode_batch([pieces[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def learn(self, new: list[bytes]) -> None:
        encoded = self.piece_ids(new)
        counts = np.fromiter(map(len, encoded), np.int64, len(new))
        ids = np.fromiter(chain.from_iterable(encoded), np.uint32, int(counts.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.used += len(ids)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each followed by ``end_id``; the count of each text."""
        if len(self.index) > self.most:
            self.clear()
        index, known, places, n_words = self.index, len(self.index), [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text.isascii():
                s = text.decode("utf-8", "replace")
                text = text if unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s).encode()
            pieces = (text if b"<|" in text else text.lower()).split()
            places.append([index.setdefault(w, len(index)) for w in pieces])
            n_words[k] = len(pieces)
        if len(index) > known:
            self.learn(list(islice(index, known, None)))
        at = np.fromiter(chain.from_iterable(places), np.int64, int(n_words.sum()))
        counts = self.counts[at]
        edges = np.concatenate([[0], np.cumsum(counts)])
        total = int(edges[-1])
        source = np.repeat(self.starts[at] - edges[:-1], counts) + np.arange(total)
        words_before = np.cumsum(n_words)
        per_text = np.diff(edges[np.concatenate([[0], words_before])])
        out = np.empty(total + len(texts), np.uint32)
        ends = np.cumsum(per_text + 1) - 1
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep], out[ends] = self.flat[source], end_id
        return out, per_text + 1


_ENCODERS: dict[str, WordCachedEncoder] = {}


def _encoder(path: str) -> WordCachedEncoder:
    """One per worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordCachedEncoder(path)
    return _ENCODERS[path]


def write_token_blocks(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_ids: int = 1 << 18
) -> None:
    """Write the ids of all whole texts (null: empty), each ended by ``end_id``, in ascending id order.

    Documents are range-partitioned by id and sorted in their partition; each
    partition streams through one task, block by block.  Rows that share an id
    are ordered by a hash of the text, then by the text; an empty table writes an empty table.
    """
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
        .withColumn("_th", F.xxhash64("_text"))
        .repartitionByRange("_id", "_th")
        .sortWithinPartitions("_id", "_th", "_text")
        .drop("_th")
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        width, block, start = max(1, int(encoder.vocab_size - 1).bit_length()), 0, 0
        ids, nulls, counts, parts, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            all_counts = np.concatenate(counts)
            row = [part, block, start, len(all_counts), held, width, np.array(ids, "<i8").tobytes(), bytes(nulls), all_counts.astype("<u4").tobytes(), pack(np.concatenate(parts), width)]
            block, start, held = block + 1, start + held, 0
            for x in (ids, nulls, counts, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size, upto = 0, at
                texts = []
                while upto < batch.num_rows and size < 1 << 20:
                    texts.append(batch.column(1)[upto].as_py())
                    size += len(texts[-1])
                    upto += 1
                got = batch.column(0).slice(at, upto - at).to_pylist()
                out, n = encoder.encode(texts, end_id)
                ids += [i or 0 for i in got]
                nulls += [i is None for i in got]
                counts.append(n)
                parts.append(out)
                held += len(out)
                at = upto
                if held >= block_ids:
                    yield flush()
        if counts:
            yield flush()

    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, unpacked from the blocks.

    ``start`` counts the ids of all documents before; it is accumulated over the
    parts' sums, of which there is one per partition.
    """
    table = spark.read.parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                counts = np.frombuffer(b["id_counts"], "<u4").astype(np.int64)
                begins = np.cumsum(counts) - counts
                ids = unpack(b["payload"], b["width"], 0, b["n_ids"]).astype("<u4")
                crc = [zlib.crc32(ids[i : i + n].tobytes()) for i, n in zip(begins, counts, strict=True)]
                names = pa.array(np.frombuffer(b["doc_ids"], "<i8"), mask=np.frombuffer(b["nulls"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(begins + b["start"] + b["base"]), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return table.join(bases, "part").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(block: dict, place: int) -> np.ndarray:
    """Random access: the ids of document number ``place`` of a block row."""
    counts = np.frombuffer(block["id_counts"], "<u4").astype(np.int64)
    return unpack(block["payload"], block["width"], int(counts[:place].sum()), int(counts[place]))
