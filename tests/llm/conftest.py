import random

import pytest


def prose(rng: random.Random, n: int) -> str:
    syllables = ["ba", "de", "ki", "lo", "mu", "na", "re", "si", "to", "vu", "é", "the"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def hard_docs():
    """(doc_id, text, source, keep_id) rows: nulls, empties, ties, repeats, long texts, copies and near copies; keep_id is a clashing name."""
    rng = random.Random(7)
    base = prose(rng, 120)
    words = base.split()
    rows = [(1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (4, "one", "b"), (5, "one two", "b"), (6, "One  TWO", "b"), (7, base, "a"), (8, base, "a"), (9, base.replace(" ", "  "), None)]
    for i in range(10, 22):
        w = list(words)
        for _ in range(i % 4 + 1):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w), "abc"[i % 3]))
    shared = prose(rng, 80)
    rows += [(i, prose(rng, 30) + " " + shared + " " + prose(rng, 30), "Z") for i in range(30, 36)]
    rows += [(40, prose(rng, 20_000), "long"), (41, "The " * 3000, "long"), (42, "The " * 2500 + "end", "long"), (43, "\x00odd \x1c bytes ümlaut ΣΑΣ, don't", "é")]
    rows += [(50, prose(rng, 60), "c"), (50, prose(rng, 60), "c"), (51, "same row again " * 20, "c"), (51, "same row again " * 20, "c")]
    return [(*r, "clash") for r in rows]


SCHEMA = "doc_id long, text string, source string, keep_id string"


@pytest.fixture(scope="session")
def hard(spark, hard_docs):
    return spark.createDataFrame(hard_docs, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
