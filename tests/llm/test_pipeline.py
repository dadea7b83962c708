"""The near-duplicate stage against brute force."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, source string, component_id string"


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The number of rows left of each group, by the pair (id, text) that stays."""
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for g in set(group):
        of = [r for r, h in zip(rows, group, strict=True) if h == g]
        ids = [r[0] for r in of if r[0] is not None]
        out.append((min(ids, default=None), len({r[1] for r in of}), {r[1] for r in of if r[0] == min(ids, default=None)}))
    return out


def check(spark, rows):
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert set(left) <= set(rows)
    want = brute(rows)
    assert len(left) == len(want)
    for i, _, texts in want:
        assert sum(r[0] == i and r[1] in texts for r in left) >= 1
    return left


def test_one_row_of_each_group_stays_on_the_hard_fixture(spark, hard_docs):
    check(spark, hard_docs)


def test_null_and_repeated_ids(spark):
    words = "one two three four five six seven eight nine ten " * 3
    other = "another text of quite other words that is not like the first " * 2
    rows = [
        (1, words, "a", "clash"), (1, words, "b", "clash"), (1, words, "a", "clash"), (1, words + "end", "c", "clash"), (None, words, "a", None),
        (None, other, "a", "clash"), (None, other, "b", "clash"), (None, other, "a", "clash"), (1, "the same id but alone and not alike", "a", "clash"),
        (None, "a third group of null ids only and", "a", "clash"), (None, None, "a", "clash"), (None, "", "a", "clash"), (3, " ", "a", "clash"), (3, " ", "a", "clash"),
    ]
    left = check(spark, rows)
    assert sum(bool((r[1] or "").strip()) for r in left) == 4


def test_empty_table(spark, empty):
    assert corpus_pipeline.near_duplicates(spark, empty, "").count() == 0


CLASH = "doc_id long, text string, source string, _id string, _epochs int, bm string, rejected string, _row int, _th string, component_id string, text_hash int, `a.b` int"


def plain(rows, items):
    """The rows without benchmark passages, by plain Python."""
    from test_pairs import brute_contamination

    hit = {k[0]: k[-1] for k in brute_contamination([(k, r[1]) for k, r in enumerate(rows)], items)}
    return [r for k, r in enumerate(rows) if not hit[k]]


def test_clashing_columns_pass_every_stage(spark, hard_docs, tmp_path):
    rows = [(i, t, s, "x", 7, "y", "z", 1, "h", "c", 2, 3) for i, t, s, _ in hard_docs]
    spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", " ".join(hard_docs[15][1].split()[:40]))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, CLASH)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        seen[name] = out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows)
            docs = spark.createDataFrame(out.collect(), CLASH)
    assert seen["toxicity"] == len(rows) and seen["benchmark decontamination"] < seen["n-gram Jaccard join"] < len(rows)
    assert seen["token-ID / binary output"] == seen["mixing sources to target weights"]


def test_decontamination_against_plain_python(spark, hard_docs, tmp_path):
    item = " ".join(hard_docs[15][1].split()[:40])
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [tuple(r) for r in hard_docs]
    left = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, plain(rows, [("q", item)])))


def test_mixing_takes_no_more_than_the_mix_says(spark):
    """Rows that repeat an id and a text, of which a budget takes some once more than others."""
    from tracewell.llm.mix_sources import mix_sources

    rows = [(1, "one two three four", "a", "c")] * 5 + [(k, "w " * (k % 7 + 1), "b", "c") for k in range(2, 40)] + [(None, None, "c", "c")] * 3 + [(50, "x y", None, "c")] * 4
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for r in mix_sources(docs).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["epochs"]
    got = {}
    for r in corpus_pipeline.mixing(spark, docs, "").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in want.items() if n}


def test_every_stage_takes_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
