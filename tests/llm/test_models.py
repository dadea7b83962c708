import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm.ppm import score_documents
from tracewell.llm.toxicity import fit_chain, run_chain, score_toxicity
from tracewell.llm.token_file import WordCachedEncoder, pack, read_document, read_token_blocks, unpack, write_token_blocks

ORDER = 5


def brute_scores(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for h, (_, t) in zip(held, rows, strict=True) if not h for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    contexts = defaultdict(Counter)
    for w, c in counts.items():
        s = b" " + w + b" "
        for p in range(1, len(s)):
            for k in range(min(p, ORDER) + 1):
                contexts[s[p - k : p]][s[p]] += c

    def coded(w):
        s, lp = b" " + w + b" ", 0.0
        for p in range(1, len(s)):
            out = set()
            for k in range(min(p, ORDER), -2, -1):
                if k < 0:
                    lp -= math.log10(257 - len(out))
                    break
                seen = contexts.get(s[p - k : p])
                if not seen:
                    continue
                total, kinds = sum(c for x, c in seen.items() if x not in out), sum(x not in out for x in seen)
                if s[p] in seen:
                    lp += math.log10(seen[s[p]] / (total + kinds))
                    break
                if kinds:
                    lp += math.log10(kinds / (total + kinds))
                out |= set(seen)
        return lp

    for h, (i, t) in zip(held, rows, strict=True):
        ws = tokens(t)
        yield i, h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), sum(map(coded, ws))


@pytest.mark.parametrize("frequent", [5, 100_000])
def test_ppm_matches_brute_force(hard, hard_docs, frequent):
    fields = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = sorted(tuple(r[f] for f in fields) for r in score_documents(hard, frequent=frequent).collect())
    want = sorted(brute_scores([(i, t) for i, t, *_ in hard_docs]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_ppm_without_training_documents(spark, empty):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = score_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()[0]
    assert (r["n_known"], r["train_tokens"]) == (0, 0) and abs(r["score"] + 4 * math.log10(257)) < 1e-9
    assert score_documents(empty).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for width in (1, 5, 15, 16, 17, 31):
        ids = rng.integers(0, 1 << width, 1001).astype(np.uint32)
        raw = pack(ids, width)
        assert len(raw) == (1001 * width + 7) // 8
        for start, n in ((0, 1001), (0, 0), (3, 10), (990, 11), (500, 1)):
            assert (unpack(raw, width, start, n) == ids[start : start + n]).all()


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer(tokenizer, hard_docs):
    encoder = WordCachedEncoder(tokenizer, most=50)
    texts = [t or "" for _, t, *_ in hard_docs] + ["Don't 'S a's ,'s <|startoftext|>x A<|STARTOFTEXT|>", "ΟΔΥΣΣΕΥΣ Σ. İ ﬁ éa é. ǅ ½ Ⅷ 日本語。 x—, \x1c a\x1cb\u00a0c ª, ²", "it'll, we've. I'm| a.,b;: ))]] \U00010400."]
    ids, counts = encoder.encode([t.encode() for t in texts], 1)
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    at = 0
    for e, n in zip(want, counts, strict=True):
        assert list(ids[at : at + n]) == [*e.ids, 1]
        at += n


def test_token_file_round_trip(spark, hard, hard_docs, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    path = f"file://{tmp_path}/ids"
    write_token_blocks(hard, path, tokenizer, block_ids=500)
    got = sorted(tuple(r) for r in read_token_blocks(spark, path).collect())
    plain, start, want = Tokenizer.from_file(tokenizer), 0, []
    for i, t, *_ in sorted(hard_docs, key=lambda r: (r[0], (r[1] or "").encode())):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    block = max((r.asDict() for r in spark.read.parquet(path).collect()), key=lambda b: b["n_docs"])
    ids = np.frombuffer(block["doc_ids"], "<i8")
    by = {i: t for i, t, *_ in hard_docs}
    assert list(read_document(block, 0)) == plain.encode(by[ids[0]] or "", add_special_tokens=False).ids + [1]


def test_token_file_null_ids_and_empty_table(spark, empty, tokenizer, tmp_path):
    write_token_blocks(spark.createDataFrame([(None, "b"), (2, "a"), (None, None)], "doc_id long, text string"), f"file://{tmp_path}/n", tokenizer)
    got = read_token_blocks(spark, f"file://{tmp_path}/n").orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(None, 1), (None, 2), (2, 2)]
    write_token_blocks(empty, f"file://{tmp_path}/e", tokenizer)
    assert read_token_blocks(spark, f"file://{tmp_path}/e").count() == 0


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    first = (x[:, 0] + x[:, 1] > 0).astype(np.int8)
    second = (first & (x[:, 2] > -0.5)).astype(np.int8)
    models = fit_chain(x, np.stack([first, second], axis=1))
    assert [len(m) for m in models] == [7, 8]
    p = run_chain(x, models)
    assert ((p[:, 0] > 0.5) == first).mean() > 0.9 and ((p[:, 1] > 0.5) == second).mean() > 0.85


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    counts = {(r["toxic"], r["rejected"]): r["count"] for r in score_toxicity(docs, labels.where(even)).join(labels.where(~even), "doc_id").groupBy("toxic", "rejected").count().collect()}
    hit, missed, false, clean = (counts.get(k, 0) for k in ((1, True), (1, False), (0, True), (0, False)))
    assert hit / (hit + missed) > 0.9 and false / (false + clean) < 0.01


def test_toxicity_odd_inputs(spark, hard, hard_docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = score_toxicity(hard, none).collect()
    assert len(rows) == len(hard_docs) and not any(r["rejected"] for r in rows)
    odd = spark.createDataFrame([(7, 0, 1), (7, 0, 1), (8, 1, None), (None, 1, 1), (999, 0, 1), (40, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert score_toxicity(hard, odd).count() == len(hard_docs)
    assert score_toxicity(empty, odd).count() == 0
