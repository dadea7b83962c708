"""PPM with contexts across tokens."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import queries
from tracewell.llm.ppm import score_documents

ORDER = 5


def stream(t):
    return b" " + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b" "


def brute_scores(rows):
    contexts = defaultdict(Counter)
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            s = stream(t)
            for p in range(1, len(s)):
                for k in range(min(p, ORDER) + 1):
                    contexts[s[p - k : p]][s[p]] += 1
    memo = {}

    def coded(context, x):
        if (context, x) not in memo:
            out, lp = set(), 0.0
            for k in range(len(context), -2, -1):
                if k < 0:
                    lp -= math.log10(257 - len(out))
                    break
                seen = contexts.get(context[len(context) - k :])
                if not seen:
                    continue
                total, kinds = sum(c for y, c in seen.items() if y not in out), sum(y not in out for y in seen)
                if x in seen:
                    lp += math.log10(seen[x] / (total + kinds))
                    break
                if kinds:
                    lp += math.log10(kinds / (total + kinds))
                out |= set(seen)
            memo[context, x] = lp
        return memo[context, x]

    for i, t in rows:
        s = stream(t)
        yield i, sum(coded(s[max(0, p - ORDER) : p], s[p]) for p in range(1, len(s)))


@pytest.mark.parametrize("block", [1 << 24, 5000])
def test_scores_match_brute_force(hard, hard_docs, block):
    got = sorted((r["doc_id"], r["score"]) for r in score_documents(hard, within_tokens=False, block=block).collect())
    want = sorted(brute_scores([(i, t) for i, t, *_ in hard_docs]))
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9)


def test_other_columns_are_those_within_tokens(hard):
    fields = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    one, two = (sorted(tuple(r[f] for f in fields) for r in score_documents(hard, within_tokens=w).collect()) for w in (True, False))
    assert [r[:5] for r in one] == [r[:5] for r in two] and np.allclose([r[5] for r in one], [r[5] for r in two])


def test_query_tells_fluent_from_shuffled_words(spark, tmp_path):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, "one two three four five six seven " * 5) for i in range(100) if i not in held]
    rows += [(held[0], "one two three four five six seven"), (held[1], "six three one seven four two five")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.op9_ppm_score(spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_no_training_documents_and_empty_table(spark, empty):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = score_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string"), within_tokens=False).collect()[0]
    assert (r["n_known"], r["train_tokens"]) == (0, 0) and abs(r["score"] + 4 * math.log10(257)) < 1e-9
    assert score_documents(empty, within_tokens=False).count() == 0
