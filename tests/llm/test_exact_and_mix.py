import hashlib
import re
from collections import Counter, defaultdict

from tracewell.llm.exact_dedup import exact_dedup
from tracewell.llm.mix_sources import mix_sources, source_targets
from tracewell.llm.url_filter import filter_urls
from tracewell.llm.license_scan import scan_licenses


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_matches_brute_force(hard, hard_docs):
    groups = defaultdict(list)
    for i, t, *_ in hard_docs:
        groups[normal(t)].append(i)
    want = Counter((i, min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)])) for i, t, *_ in hard_docs)
    got = Counter(tuple(r) for r in exact_dedup(hard).collect())
    assert got == want


def test_exact_dedup_with_a_saturated_bitmap(hard):
    full = sorted(tuple(r) for r in exact_dedup(hard).collect())
    assert sorted(tuple(r) for r in exact_dedup(hard, bitmap_bits=32768, prefix_chars=1).collect()) == full


def test_exact_dedup_null_ids_and_empty_table(spark, empty):
    df = spark.createDataFrame([(None, "x"), (3, "x"), (None, "y")], "doc_id long, text string")
    assert {tuple(r) for r in exact_dedup(df).collect()} == {(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)}
    assert exact_dedup(empty).count() == 0


def test_mix_meets_targets_and_reruns_agree(hard, hard_docs, empty):
    rows = mix_sources(hard).collect()
    assert len(rows) == len(hard_docs)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mix_sources(hard.repartition(7)).collect()))
    by = defaultdict(list)
    source = {i: s for i, _, s, _ in hard_docs}
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        by[source[r["doc_id"]]].append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"]
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs) / 2 + 1e-6
    assert abs(sum(rs[0]["target"] for rs in by.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert mix_sources(empty).count() == 0


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1000), (None, 10)], "_source string, _size long")
    got = {r["_source"]: r["_target"] for r in source_targets(sizes, (1.0, 2.0, 3.0), 3.0).collect()}
    # By hand: total 1111, weights 1, 2, 3, 1; b stops at 3, a at at most 300, null at 30.
    assert got["b"] == 3.0 and got[None] == 30.0
    assert abs(sum(got.values()) - 1111) < 1e-9 and abs(got["c"] / 3 - got["a"]) < 1e-9


def judged(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h), len(p), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, verdict, rule = max(fits, default=(0, 0, "allow", None))
    return host, path, rule, verdict


def test_url_filter(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "a.com", "/")]
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x?y#z", "https://x.example.org/en/12", "https://x.example.org/en/2", "http://org/", "http://org", "http://notorg/x",
            "http://b.a.com/de/1", "http://q.com/de/", "http://q.com/fr", "http://q.com/fr/?a", "x://y://example.org/es/", "http://É.org/es/", "http://" + "a." * 500 + "com/de/" + "p" * 5000, "http://q.com/de/", "http://q.com?u=/de/", "//q.com/de/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in filter_urls(df, rules).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    assert filter_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in filter_urls(df, []).collect()} == {"allow"}


def test_license_scan(spark):
    texts = {
        1: None, 2: "", 3: "nothing here. At all!", 4: "Intro.\nReleased under the MIT License.\nrest", 5: "x. This work is licensed under the GNU General Public License, version 3. y",
        6: "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. foo. You may obtain a copy of the License at",
        7: "Released under the MIT License. Licensed under CC BY-NC 4.0.", 8: "not Released under the MIT License at all", 9: "word " * 50_000 + ". RELEASED   under the MIT license!",
        10: "You may obtain a copy of the License at. Licensed under the Apache License, Version 2.0.",
    }
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, license string")
    got = {r["doc_id"]: (r["license"], r["licenses"]) for r in scan_licenses(df).collect()}
    assert got == {1: (None, ""), 2: (None, ""), 3: (None, ""), 4: ("MIT", "MIT"), 5: ("GPL-3.0", "GPL-3.0"), 6: ("Apache-2.0", "Apache-2.0"), 7: ("MIT", "MIT,CC-BY-NC-4.0"), 8: (None, ""), 9: ("MIT", "MIT"), 10: ("Apache-2.0", "Apache-2.0")}
    six = [r for r in scan_licenses(df).collect() if r["doc_id"] == 6][0]
    assert six["rule_numbers"] == "4" and six["sentence_ids"] == "apache-2-notice,apache-compliance,apache-copy-at"
    assert scan_licenses(df.limit(0)).count() == 0
