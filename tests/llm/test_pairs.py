import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm.decontaminate import decontaminate
from tracewell.llm.graph import components
from tracewell.llm.ngram_jaccard import Schemes, differing, jaccard_components, signatures, sketch
from tracewell.llm.suffix_dedup import RunLengthIndex, _parts, _sorted_places, _suffix_order, dedup_substrings


def lower(text):
    return (text or "").encode().lower()


def brute_components(rows, k, num):
    sets, parent = [], {}
    for i, t in rows:
        w = lower(t).split()
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[root(a)].append(i)
    return Counter((i, len(s), min(least[root(a)])) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(hard, hard_docs, k, num):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(hard, k=k, num=num).collect())
    assert got == brute_components([(i, t) for i, t, *_ in hard_docs], k, num)


def test_jaccard_of_a_dense_group(spark):
    """Copies at many distances around one text, so that components hang on few links."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5])):
            w[rng.randrange(90)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df, k=3, num=90).collect())
    assert got == brute_components(rows, 3, 90)


def test_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n), dtype=np.uint64)) for n in rng.integers(1, 900, 40)]
    sets += [np.unique(np.concatenate([s[len(s) // 9 :], s[:1] + np.uint64(1)])) for s in sets]
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    least = differing([sketch(s) for s in sets], x, y, block=1 << 12)
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)])
    assert (least <= true).all() and (least[x == y] == 0).all() and least[x != y].min() > 0


def test_jaccard_empty(empty):
    assert jaccard_components(empty).count() == 0


def test_sets_within_the_bound_share_a_signature():
    rng = np.random.default_rng(1)
    for num in (80, 90):
        schemes = Schemes(num, 100)
        for _ in range(300):
            n = int(rng.integers(8, 400))
            pool = np.unique(rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64))
            a = pool[:n]
            most = (100 - num) * 2 * n // (100 + num)
            drop = int(rng.integers(0, most // 2 + 1))
            b = np.unique(np.concatenate([a[drop:], pool[n : n + most // 2 - drop]]))
            a, union, both = np.sort(a), len(np.union1d(a, b)), len(np.intersect1d(a, b))
            if 100 * both >= num * union and union > both:
                assert np.intersect1d(signatures(a, schemes), signatures(b, schemes)).size


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    assert got == {x: root(x) for u, v in edges if u != v for x in (u, v)}


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    lengths = {len(x) for x in windows}
    out = Counter()
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


def test_decontamination(spark, hard, hard_docs):
    by = {i: t for i, t, *_ in hard_docs}
    long_words = by[30].split()
    items = [(1, " ".join(long_words[40:60])), (2, " ".join(long_words[45:58]).upper()), (3, "one two"), (4, None), (5, " ... "), (10, " ".join(by[40].split()[500:530])), (11, "The the THE the the the the the the the the the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fields = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = Counter(tuple(r[f] for f in fields) for r in decontaminate(hard, bench).collect())
    assert got == brute_contamination([(i, t) for i, t, *_ in hard_docs], items)
    none = decontaminate(hard, bench.limit(0)).collect()
    assert len(none) == len(hard_docs) and not any(r["n_hit"] or r["contaminated"] for r in none)
    assert decontaminate(hard.limit(0), bench).count() == 0


def brute_removal(rows, length=50):
    starts = defaultdict(lambda: 1 << 62)
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            starts[b[p : p + length]] = min(starts[b[p : p + length]], i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[(i, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_substring_removal(hard, hard_docs):
    fields = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = Counter(tuple(r[f] for f in fields) for r in dedup_substrings(hard).collect())
    assert got == brute_removal([(i, t) for i, t, *_ in hard_docs])


def test_substring_removal_nulls(spark, empty):
    text = "a passage of more than fifty bytes that two documents have in common"
    df = spark.createDataFrame([(None, text), (1, "x" + text), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in dedup_substrings(df).collect()}
    assert got == {None: 0, 1: len(text), 2: 0}
    assert dedup_substrings(empty).count() == 0


def test_run_length_index_streams_exact_matches():
    rng = random.Random(3)
    strings = list(dict.fromkeys(bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 30))) for _ in range(40)))
    owners = np.array([rng.randint(0, 20) for _ in strings])
    index, seen = RunLengthIndex(strings, owners, 4), 0
    for numbers, places, least in index.stream(strings):
        for k, p, m in zip(numbers, places, least, strict=True):
            w = strings[k][p : p + 4]
            assert m == min(owners[j] for j, s in enumerate(strings) if w in s)
            seen += 1
    assert seen == sum(max(0, len(s) - 3) for s in strings)
    assert len(index.heads) < sum(len(s) + 1 for s in strings)


@pytest.mark.parametrize("depth", [3, 4, 5, 9, 50])
def test_suffix_order_and_classes(depth):
    rng = random.Random(depth)
    strings = [b"a" * 130, b"", b"ab" * 60, b"a" * 129, b"\xff\x00" * 3] + [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(60)] + [b"ab" * 60]
    text = np.array([c for s in strings for c in [*(b + 1 for b in s), 0]])
    to_end = np.concatenate([np.arange(len(s), -1, -1) for s in strings])
    suffixes = [[*(b + 1000 for b in s[i:]), k] for k, s in enumerate(strings) for i in range(len(s) + 1)]
    order, starts = _suffix_order(text, to_end, depth)
    assert order.tolist() == sorted(range(len(text)), key=suffixes.__getitem__)
    heads = [suffixes[p][:depth] for p in order]
    assert starts.tolist() == [i for i, h in enumerate(heads) if not i or h != heads[i - 1]]


def test_an_index_holds_few_anchors():
    rng = np.random.default_rng(1)
    anchors, sizes = rng.integers(0, 40, 3000).astype("<u4"), rng.integers(50, 70, 3000).astype("<u4")
    sizes[anchors == 7] += 900
    parts = list(_parts(anchors, sizes, 20_000))
    assert sorted(np.concatenate(parts).tolist()) == list(range(3000)) and sum(len(set(anchors[p])) for p in parts) == 40
    largest = int(np.bincount(anchors, sizes).max())
    assert all(sizes[p].sum() < 20_000 + largest for p in parts) and len(parts) > 5
    assert list(_parts(anchors[:0], sizes[:0])) == []


def test_places_are_sorted_alike_whatever_their_width():
    keys = np.random.default_rng(2).integers(0, 9, 500)
    for width in (4, 60):
        got, at = _sorted_places(keys, width)
        assert at.tolist() == np.argsort(keys, kind="stable").tolist() and got.tolist() == sorted(keys.tolist())
