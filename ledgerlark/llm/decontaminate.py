"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text becomes words; k-grams of `K` words are hashed; each window of `WINDOW - K + 1` k-grams keeps its smallest hash. Two
texts that share `WINDOW` words therefore share a kept hash, so joining the kept hashes loses no shared passage. Around each
joined hash the hit is extended to the `WINDOW`-word windows it stands for, and these are compared word by word.
A benchmark item of fewer words is one window of its own, found through its longest word.

The kept hashes of the benchmark are broadcast while there are at most `BROADCAST_ROWS` of them; beyond that documents join
them by shuffling (hash, row, position) and fetch their words again by row.

Edge cases: a null or empty text has no words, so it is neither hit nor an item window; a document row is known by doc_id
(null allowed) and text, so repeated rows give equal rows, one each; an empty documents table gives no rows, an empty
benchmark no hits; items with equal texts all count; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import saved

WINDOW, K = 10, 5
BROADCAST_ROWS = 1_000_000
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), GAPS), "")


def winnowed(rows: DataFrame) -> DataFrame:
    """Adds h (word hashes) and m (the kept hash of the window starting at each word; empty below WINDOW words) to words."""
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    gram = ", ".join(["x", *(f"get(h, i + {j})" for j in range(1, K))])
    rows = rows.withColumn("g", F.expr(f"transform(h, (x, i) -> xxhash64({gram}))"))
    least = f"transform(sequence(1, size(g) - {WINDOW - 1}), s -> array_min(slice(g, s, {WINDOW - K + 1})))"
    return rows.withColumn("m", F.expr(f"if(size(g) < {WINDOW}, cast(array() as array<bigint>), {least})"))


def _keys(length: str) -> Column:
    return F.expr(f"array_join(slice(words, s + 1, {length}), ' ')")


def _with_words(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """hits (doc_id, th, hit) with the words of their text, which is fetched once for all hits of a row."""
    rows = hits.groupBy("doc_id", "th").agg(F.collect_set("hit").alias("hits")).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    whole = texts.dropDuplicates(["doc_id", "th"])
    return rows.join(whole, rows["_d"].eqNullSafe(whole["doc_id"]) & (rows["_t"] == whole["th"])).select("doc_id", "th", "words", F.explode("hits").alias("hit"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs (doc_id, text)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words"))
    hits = hit_windows(texts, items)
    found, windows = saved(hits[0]), hits[1]
    ends = "max(s + n) over (partition by doc_id, th order by s, n rows between unbounded preceding and 1 preceding)"
    covered = (found.select("doc_id", "th", "s", "n", F.expr(ends).alias("past"))
               .groupBy("doc_id", "th").agg(F.sum(F.expr("greatest(0, s + n - greatest(s, coalesce(past, 0)))")).alias("n_hit")))
    listed = (found.select("doc_id", "th", "key").distinct().join(windows.select("key", "item_id"), "key")
              .select("doc_id", "th", F.col("item_id").cast("string").alias("item")).distinct()
              .groupBy("doc_id", "th").agg(F.count("item").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items")))
    counts = texts.select("doc_id", "th", F.size("words").cast("long").alias("n_words"))
    out = counts
    for part in (covered, listed):
        part = part.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
        out = out.join(part, out["doc_id"].eqNullSafe(part["_d"]) & (out["th"] == part["_t"]), "left").drop("_d", "_t")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
                      F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"))


def hit_windows(texts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, s, n, key) of every window of the items found in texts, and the windows: key, item_id."""
    wins = winnowed(items.select("item_id", words_of(F.col("text")).alias("words"))).where("size(words) > 0")
    starts = wins.select("item_id", "words", "m", F.expr(f"explode(sequence(0, greatest(0, size(words) - {WINDOW})))").alias("s"))
    windows = saved(starts.select("item_id", _keys(str(WINDOW)).alias("key"), F.expr("get(m, s)").alias("fp"),
                                  F.when(F.col("fp").isNull(), F.col("words")).alias("short")).distinct())
    keys = windows.where("fp is not null").select("key", "fp").distinct()
    kept = keys.select("fp").distinct()
    small = keys.count() <= BROADCAST_ROWS
    held = F.broadcast if small else (lambda df: df)

    doc = winnowed(texts)
    step = WINDOW - K + 1
    # outer: else the optimizer copies the whole array expression into a filter below, to be worked out for every element
    anchors = doc.select("doc_id", "th", "words", "m", F.posexplode_outer("m").alias("s", "fp")).where(f"s % {step} = 0 or get(m, s - 1) <> fp")
    if small:
        near = anchors.join(held(kept), "fp", "left_semi")
    else:
        at = anchors.select("doc_id", "th", "s", "fp").join(kept, "fp", "left_semi").select("doc_id", "th", F.struct("s").alias("hit"))
        near = _with_words(at, texts).select("doc_id", "th", "words", "hit.s")
    near = near.select("doc_id", "th", "words", F.expr(f"explode(sequence(s, least(s + {step - 1}, size(words) - {WINDOW})))").alias("s"))
    near = near.select("doc_id", "th", "s", F.lit(WINDOW).alias("n"), _keys(str(WINDOW)).alias("key"))
    found = near.join(held(keys.select("key").distinct()), "key", "left_semi")

    short = windows.where("fp is null").select("key", "short").distinct()
    if not short.isEmpty():
        longest = "array_max(transform(short, (w, i) -> struct(length(w) as l, -i as i, w as w)))"
        short = short.select(F.col("key").alias("want"), F.size("short").alias("n"), F.expr(longest).alias("of"))
        short = short.select("want", "n", (-F.col("of.i")).alias("off"), F.xxhash64("of.w").alias("hw"))
        words = texts.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).select("doc_id", "th", "words", F.posexplode_outer("h").alias("p", "hw"))
        if short.count() <= BROADCAST_ROWS:
            fits = words.join(F.broadcast(short), "hw").withColumn("s", F.col("p") - F.col("off"))
        else:
            at = words.drop("words").join(short, "hw").select("doc_id", "th", F.struct((F.col("p") - F.col("off")).alias("s"), "n", "want").alias("hit"))
            fits = _with_words(at, texts).select("doc_id", "th", "words", "hit.*")
        fits = fits.where("s >= 0 and s + n <= size(words)").where(_keys("n") == F.col("want"))
        found = found.select("doc_id", "th", "s", "n", "key").unionByName(fits.select("doc_id", "th", "s", "n", F.col("want").alias("key")))
    return found.select("doc_id", "th", "s", "n", "key").distinct(), windows
