"""Log queries over whole lines."""

import re

from tracewell import queries

FAR = "x" * 3000
TEXTS = {
    1: None, 2: "one long line " + FAR + " Exception at the end",
    3: "\n".join(["a", "b " + FAR + " end of error", "c", "d " + FAR + " end of cause", "e", "f", "after " + FAR + " ERROR far", " at y", "", "noise", "Caused by:  late " + FAR]),
    4: "no block", 5: "\n\n",
}


def brute(text):
    lines = []
    for p, t in enumerate((text or "").split("\n")):
        lines.append((2 * p, f"ERROR at {t}" if p % 7 == 1 else f"Caused by: x{p} {t}" if p % 7 == 3 else t))
        if p % 7 == 5:
            lines.append((2 * p + 1, ""))
    blocks, inside = [], False
    for n, line in lines:
        if re.search("Exception|ERROR|Caused by", line):
            blocks.append([])
            inside = True
        if inside:
            blocks[-1].append((n, line))
        if not line.strip(" "):
            inside = False
    return blocks


def test_whole_lines(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(f, k): b for f, t in TEXTS.items() for k, b in enumerate(brute(t), 1)}
    run = lambda name: [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(run("log_blocks_whole")) == sorted((*k, n) for k, b in want.items() for n, _ in b)
    causes = {k: ([c for _, line in b for c in re.findall(r"Caused by:\s+(.*)", line)] or ["NO ROOT CAUSE FOUND"])[-1] for k, b in want.items()}
    assert {(f, k): c for f, k, c in run("log_root_whole")} == causes and any(c.endswith("end of cause") for c in causes.values())
    assert dict(run("log_count_whole")) == {f: max(k for g, k in want if g == f) for f in {f for f, _ in want}} and (2, 1) in want
