"""Ranks by chunks against windows over whole groups."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import recon


def test_rank_against_window(spark):
    """One key with most rows, a null key, ties, null orders, and an empty table."""
    rng = random.Random(4)
    made = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(-20, 20)])) for i in range(800)]
    df = spark.createDataFrame(made, "id int, key string, v long")
    w = Window.partitionBy("key").orderBy("v")
    want = {r["id"]: r["rank"] for r in df.where("v is not null").select("id", F.rank().over(w).alias("rank")).collect()}
    for chunk in (1, 7, 1000):
        got = recon.rank_of(df, ["key"], "v", chunk=chunk)
        assert got.columns == [*df.columns, "rank"]
        assert {r["id"]: r["rank"] for r in got.collect()} == {i: want.get(i) for i, *_ in made}
    totals = {r["key"]: r["total"] for r in recon.total_of(df, ["key"], F.sum("v")).collect()}
    assert totals == {k: sum(v or 0 for _, key, v in made if key == k) for k in ("hot", "a", None)}
    assert recon.rank_of(df.limit(0), ["key"], "v").count() == 0
