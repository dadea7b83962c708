"""BPE by segment trees against the library that reads the same files."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm.bpe import SegmentTreeBpe, TextEncoder, decode_ids, encode_texts

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def odd_texts() -> list[str]:
    rng = random.Random(3)
    letters = "abcdeßéΣİ１２ <|>'s\t\ń  \x85\x1c.,!?Ǆ😀漢字"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(600)]
    return made + ["", " ", "x<|endoftext|>y <|startoftext|><|endoftext|>", "don't we'll I'm", "\x00\x01", "lowest" * 400, "the " * 500, "<|endoftext", "é ́e"]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_library_s(name):
    path, texts = public_tokenizers.path(name), odd_texts()
    encoder, library = TextEncoder(path), Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(2):  # the second time from what is kept
        ids, ends = encoder.encode([t.encode() for t in texts])
        for k, t in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def plain_merges(model: SegmentTreeBpe, word: list[int]) -> list[int]:
    """The leftmost pair of lowest rank, looked up anew after every merge."""
    word = list(word)
    while True:
        pairs = [(model.rank_of[k], i) for i in range(len(word) - 1) if (k := word[i] * model.base + word[i + 1]) in model.rank_of]
        if not pairs:
            return word
        rank, i = min(pairs)
        word[i : i + 2] = [int(model.merged[rank])]


def test_trees_of_any_width_against_plain_merging():
    merges = [("a", "a"), ("aa", "aa"), ("b", "a"), ("aa", "b"), ("ba", "b"), ("aaaa", "b"), ("b", "b"), ("bb", "bb")]
    vocab = {s: i for i, s in enumerate(["a", "b", "aa", "aaaa", "ba", "aab", "bab", "aaaab", "bb", "bbbb"])}
    model = SegmentTreeBpe({"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]})
    rng = random.Random(5)
    words = ["".join(rng.choice("aab") for _ in range(n)) for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 33, 63, 64, 65, 66, 200, 1000] * 8]
    for word, got in zip(words, model.encode_words(words), strict=True):
        start = [vocab[c] for c in word]
        assert np.frombuffer(got, "<i4").tolist() == plain_merges(model, start) == model.encode_long(start)
    assert model.encode_words(["", "x", "axb", "a"]) == [b"", b"", np.array(plain_merges(model, [0, 1]), "<i4").tobytes(), bytes(4)]


def test_models_that_are_not_supported():
    with pytest.raises(ValueError):
        SegmentTreeBpe({"type": "WordPiece", "vocab": {}, "merges": []})
    with pytest.raises(ValueError):
        SegmentTreeBpe({"type": "BPE", "vocab": {}, "merges": [], "byte_fallback": True})


@pytest.mark.parametrize("name", FILES)
def test_texts_to_ids_and_back(spark, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = [*odd_texts(), None, "same", "same", "word " * 60_000]
    docs = spark.createDataFrame([(None if k == 5 else k // 2, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, `_v` string, `a.b` string")
    coded = decode_ids(encode_texts(docs, path, keep=["doc_id", "text", "a.b"]), path)
    assert coded.columns == ["doc_id", "text", "a.b", "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_decoding_skips_what_no_token_has(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    given = spark.createDataFrame([(1, [320, None, -1, 10**6, 49407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in decode_ids(given, path).collect()}
    library = Tokenizer.from_file(path)
    assert got == {1: library.decode([320, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_empty_tables_and_clashing_names(spark, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert decode_ids(encode_texts(empty, path), path).collect() == []
    for wrong in (lambda: encode_texts(empty.withColumn("ids", F.lit(1)), path, keep=["ids"]), lambda: decode_ids(encode_texts(empty.withColumn("decoded", F.lit(1)), path, keep=["decoded"]), path)):
        with pytest.raises(ValueError):
            wrong()


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    import tracewell.llm.bpe as bpe

    monkeypatch.setattr(bpe, "MOST_PIECES", 50)
    encoder, library = TextEncoder(public_tokenizers.path(FILES[0])), Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    for k in range(6):
        texts = [f"word{k}{i} again" for i in range(40)]
        ids, ends = encoder.encode([t.encode() for t in texts])
        assert np.split(ids, ends[1:-1])[3].tolist() == library.encode(texts[3], add_special_tokens=False).ids
        assert len(encoder.index) <= 50 + 41
