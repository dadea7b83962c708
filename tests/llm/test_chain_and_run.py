"""The classifier chain and the pipeline as a whole, recomputed by plain code."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pipeline import brute, plain

import corpus_pipeline
from tracewell.llm.mix_sources import mix_sources
from tracewell.llm.toxicity import SEEDS, score_toxicity

BAD = [w for words in SEEDS.values() for w in words]


def made(n):
    """(doc_id, text, source) and (doc_id, quality, toxic) rows; each fourth document is toxic."""
    rng = random.Random(3)
    words = ["".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(30, 60))]
        for _ in range(0 if i % 4 else 4):
            text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", "!", ","]))
        docs.append((i, " ".join(text), "abc"[i % 3]))
        labels.append((i, i % 2, int(i % 4 == 0)))
    return docs, labels


def grams(text):
    found = Counter()
    for w in (text or "").lower().split():
        core = w.strip(".,;:!?|\"'()[]{}<>*#$%&-_")
        if core:
            found.update({zlib.crc32(g.encode()) for g in ["w" + core] + ["p" + core[:k] for k in (4, 5, 6) if k < len(core)]})
    return found


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(x, y):
    """(weights, constant) of a logistic model by Adam in double precision."""
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w, c = np.zeros(x.shape[1]), np.log(share / (1 - share))
    if len(set(y)) == 1:
        return w, c
    unit = 1 / np.maximum(np.sqrt((x * x).mean(axis=0)), 1e-3)
    z = x * unit
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, 121):
        off = sigmoid(z @ w + c) - y
        slope = np.append((z * off[:, None]).mean(axis=0) + 2e-3 * w, off.mean())
        first, second = first * 0.9 + slope * 0.1, second * 0.999 + slope**2 * 0.001
        step = 0.15 * (1 - t / 121) * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, c = w - step[:-1], c - step[-1]
    return w * unit, c


def chain(spark, docs, labels, texts, max_features):
    """Probabilities of each text, one column per category."""
    toxic = {i: t for i, _, t in labels}
    frame = spark.createDataFrame([d[:2] for d in docs if d[0] in toxic], "doc_id long, text string")
    train = [(r[0], r[1]) for r in sorted(frame.select("doc_id", "text", F.xxhash64("doc_id", "text")).collect(), key=lambda r: r[2])]
    y = np.array([[*(toxic[i] and bool(re.search(r"(?i)\b(?:" + "|".join(ws) + r")\b", t)) for ws in SEEDS.values()), toxic[i]] for i, t in train], float)
    seen, n1 = [grams(t) for _, t in train], y[:, -1].sum()
    n0 = len(train) - n1

    def weight(g):
        in1 = sum(g in s for s, k in zip(seen, y[:, -1], strict=True) if k) / n1
        in0 = sum(g in s for s, k in zip(seen, y[:, -1], strict=True) if not k) / n0
        return abs(in1 - in0) / np.sqrt((in1 + in0) / 2 + 1 / n1)

    chosen = sorted(sorted(set().union(*seen)), key=weight, reverse=True)[:max_features]

    def table(ts):
        return np.array([[grams(t)[g] / np.sqrt(max(1, len((t or "").split()))) for g in chosen] for t in ts])

    x, rows = table([t for _, t in train]), table(texts)
    fold = np.arange(len(train)) % 3
    for k in range(y.shape[1]):
        unseen = np.zeros(len(train))
        for f in range(3):
            w, c = descend(x[fold != f], y[fold != f, k])
            unseen[fold == f] = sigmoid(x[fold == f] @ w + c)
        w, c = descend(x, y[:, k])
        x, rows = np.column_stack([x, unseen]), np.column_stack([rows, sigmoid(rows @ w + c)])
    return rows[:, len(chosen) :]


@pytest.mark.parametrize("max_features", [40, 100_000])
def test_chain_scores_against_plain_code(spark, max_features):
    docs, labels = made(120)
    docs += [(500, None, "a"), (501, "", "a"), (502, "You IDIOT", "a"), (503, "?!", None)]
    got = score_toxicity(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_features=max_features)
    found = {r["doc_id"]: ([r[f"p_{c}"] for c in (*SEEDS, "toxic")], r["rejected"]) for r in got.collect()}
    want = chain(spark, docs, labels, [d[1] for d in docs], max_features)
    assert len(found) == len(docs)
    for (i, *_), p in zip(docs, want, strict=True):
        assert np.allclose(found[i][0], p, atol=1e-3), (i, found[i], p)  # features are held in single precision
        assert found[i][1] == (found[i][0][-1] >= 0.4)


def test_run_as_a_whole_against_plain_code(spark, tmp_path):
    """Only the mix's own choice, which its SQL checks, is taken from the operator."""
    tokenizer = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    docs, labels = made(80)
    passage = docs[5][1].split()[:25]
    docs += [(100 + i, docs[i][1], "c") for i in (1, 2, 3)] + [(110 + i, docs[i][1] + " ending", "a") for i in (1, 6, 7)]
    docs += [(120, "zu " + " ".join(passage) + " zu zo", "b"), (121, None, "a"), (122, "", None), (123, " \t", "b"), (124, "You idiot, worthless clown! trash", "a")]
    items = [("q", " ".join(passage))]
    schema = "doc_id long, text string, source string"
    for name, rows, columns in (("documents", docs, schema), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id string, text string")):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")

    toxic = chain(spark, docs, labels, [d[1] for d in docs], 512)[:, -1]
    assert (abs(toxic - 0.4) > 0.01).all()
    left = [d for d, p in zip(docs, toxic, strict=True) if p < 0.4]
    assert 60 < len(left) < len(docs) - 15
    kept = {i for i, *_ in brute(left)}
    unique = [d for d in left if d[0] in kept]
    clean = plain(unique, items)
    assert len(docs) > len(left) > len(unique) > len(clean) > 40
    epochs = {r["doc_id"]: r["epochs"] for r in mix_sources(spark.createDataFrame(clean, schema)).collect()}
    encoder, start, want = Tokenizer.from_file(tokenizer), 0, []
    for i, text, _ in sorted(clean):
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for _ in range(epochs[i]):
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
