"""Benchmark decontamination by winnowing.

Both sides keep the least k-gram hash of every run of w consecutive k-grams.  A
shared run of k + w - 1 words contains a whole run of k-grams, and so a shared
fingerprint: with k + w - 1 = 13 no shared 13-word window is missed.  Shared
fingerprints only choose the documents to look at; their windows are then
compared in full and the hits extended to the words that they cover.  What the
scan of the documents is filtered by is a bitmap of fixed size, so neither the
benchmark nor the candidates need to fit a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, bitmap_of, cut, flag_in_bitmap, let

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), NOT_WORD), lambda w: w != "")


def grams(items: Column, k: int, value) -> Column:
    """``value`` of each slice of ``k`` consecutive items; null when there are fewer."""

    def of(a: Column) -> Column:
        n = F.size(a) - F.lit(k - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: value(F.slice(a, i, F.lit(k)))))

    return let(items, of)


def fingerprints(word_array: Column, k: int, w: int) -> Column:
    """Distinct winnowed hashes; none when there are fewer than k + w - 1 words."""
    return F.array_distinct(grams(grams(word_array, k, F.xxhash64), w, F.array_min))


def window_key(word_slice: Column) -> Column:
    return F.md5(F.array_join(word_slice, " "))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    k: int = 7,
    share: int = 20,
    bitmap_bits: int = 1 << 23,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items (array), items_sha256, contaminated, text_hash (xxhash64).

    A word inside any occurrence of a benchmark window is hit; an item with
    fewer words than ``window`` is one window, one without words is none.
    Contaminated: n_hit > 0 and share * n_hit >= n_words.  Null texts have no
    words.  Rows that repeat id and text get the same result each; a null id is
    an id like others; null item ids count as one item with an empty name.  An
    empty benchmark or table leaves nothing contaminated.
    """
    w = window - k + 1
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_h", F.xxhash64("_text"))

    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("_item"), words(F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))).alias("_w")).where(F.size("_w") > 0)
    size = F.least(F.lit(window), F.size("_w"))
    item_windows = cut(
        items.select("_item", size.alias("_len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - size + 1), lambda i: window_key(F.slice("_w", i, size)))).alias("_win")).distinct()
    )
    # At most window - 1 numbers: the lengths of items shorter than a window.
    short = sorted(r[0] for r in item_windows.where(F.col("_len") < window).select("_len").distinct().collect())
    windows = item_windows.select("_win", "_len").distinct().withColumn("_winhash", F.xxhash64("_win"))
    win_bits = cut(bitmap_of(windows, "_winhash", bitmap_bits))

    wanted = items.select(F.explode(fingerprints(F.col("_w"), k, w)).alias("_f")).distinct()
    prints = base.select("_id", "_h", words(F.col("_text")).alias("_w")).select("_id", "_h", F.explode(fingerprints(F.col("_w"), k, w)).alias("_f"))
    found = flag_in_bitmap(prints, "_f", bitmap_of(wanted, "_f", bitmap_bits), bitmap_bits, "_hit", "inner").where("_hit").join(wanted, "_f")
    docs_found = found.select(F.xxhash64("_id", "_h").alias("_key")).distinct()
    near = flag_in_bitmap(base.withColumn("_key", F.xxhash64("_id", "_h")), "_key", bitmap_of(docs_found, "_key", bitmap_bits), bitmap_bits, "_near", "inner").where("_near")

    def occurrences(rows: DataFrame, length: int) -> DataFrame:
        keyed = rows.select("_id", "_h", words(F.col("_text")).alias("_w")).select("_id", "_h", F.posexplode(grams(F.col("_w"), length, window_key)).alias("_pos", "_win"))
        likely = flag_in_bitmap(keyed.withColumn("_winhash", F.xxhash64("_win")), "_winhash", win_bits, bitmap_bits, "_hit", "inner").where("_hit")
        return likely.join(windows.where(F.col("_len") == length).select("_win", "_len"), "_win").select("_id", "_h", "_pos", "_len", "_win")

    hits = occurrences(near, window)
    for length in short:
        hits = hits.unionByName(occurrences(base, length))
    hits = cut(hits.distinct())

    before = Window.partitionBy("_id", "_h").orderBy("_pos", "_len", "_win").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("_pos") + F.col("_len")
    covered = (
        hits.withColumn("_prev", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("_id", "_h")
        .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("_pos", "_prev"))).alias("_n_hit"))
    )
    named = (
        hits.select("_id", "_h", "_win").distinct().join(item_windows.select("_win", "_item"), "_win")
        .groupBy("_id", "_h").agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    )
    per_doc = covered.join(named, covered["_id"].eqNullSafe(named["_id"]) & (covered["_h"] == named["_h"])).select(
        covered["_id"].alias("_hid"), covered["_h"].alias("_hh"), "_n_hit", "_items"
    )
    counted = base.select("_id", "_h", F.regexp_count("_text", F.lit(WORD_ANY_CASE)).alias("_n"))
    out = counted.join(per_doc, F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_h") == F.col("_hh")), "left")
    n_hit = F.coalesce("_n_hit", F.lit(0)).cast("long")
    named_items = F.coalesce("_items", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(named_items).cast("long").alias("n_items"),
        named_items.alias("items"),
        F.sha2(F.array_join(named_items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("_n"))).alias("contaminated"),
        F.col("_h").alias("text_hash"),
    )
