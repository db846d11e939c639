"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words of benchmark items become windows of ``n`` words (an item of fewer is one window). Training texts are
scanned window by window: the 64-bit hashes of a document's windows are exploded and probe the set; hits come
back to their document, where the words themselves are compared, so a hash collision hits nothing. Columns only.

The set is broadcast while it has at most ``max_broadcast`` windows; a larger one is left to Spark's own join.

Defined results: NULL, empty and wordless texts have no words and no hit; items without a word have no window;
items equal in ``item_id`` are one item, and a NULL ``item_id`` counts as an empty one; equal documents
are judged alike; empty tables give no hits. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import keep_rows, stored, text_key

# Fixed value: letters, digits and everything outside ASCII make words (ranges are much faster than their complement).
TOKEN = r"[0-9A-Za-z\x80-\x{10FFFF}]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def window_hashes(word_hashes: Column, n: int) -> Column:
    """One hash for every ``n`` consecutive words, in order."""
    starts = F.when(F.size(word_hashes) >= n, F.sequence(F.lit(0), F.size(word_hashes) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(n)]))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """``item, length, hash, window``: the different windows of every item."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"),
    ).filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    windows = items.select("item", "length", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("length")))).alias("words"))
    return windows.select("item", "length", F.array_join("words", " ").alias("window"), "words").distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast: int = 1_000_000) -> DataFrame:
    """``__id, __text, n_words, n_hit, items``: one row per row of ``docs``; ``items`` are sorted strings."""
    windows = benchmark_windows(benchmark, n)
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # n values at most
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    chains = [F.when(F.col("length") == m, F.xxhash64(*[F.get(hashes, F.lit(k)) for k in range(m)])) for m in lengths]
    windows = stored(windows.select("item", "length", "window", F.coalesce(*chains, F.lit(0)).alias("hash")))
    probe = windows.select("hash", "length", "window").distinct()
    if probe.count() <= max_broadcast:
        probe = F.broadcast(probe)

    rows = docs.select(F.col("doc_id").alias("__id"), text_key(F.col("text")).alias("__text"), "text")
    hashed = rows.select("__id", "__text", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    sized = hashed.withColumn("n_words", F.size("h"))
    arrays = [window_hashes(F.col("h"), m) for m in lengths] or [F.array().cast("array<bigint>")]
    scanned = sized.select("__id", "__text", "n_words", F.posexplode(F.concat(*arrays)).alias("at", "hash"))
    before, offset = F.lit(0), F.lit(0)
    for m in lengths:  # windows of length m follow those of all shorter lengths
        offset = F.when(F.col("length") == m, before).otherwise(offset)
        before = before + F.greatest(F.col("n_words") - m + 1, F.lit(0))
    hit = F.struct((F.col("at") - offset).alias("at"), "length", "window")
    hits = scanned.join(probe, "hash").groupBy("__id", "__text").agg(F.collect_set(hit).alias("hits"))

    joined = rows.alias("r").join(
        hits.alias("h"), F.col("r.__id").eqNullSafe(F.col("h.__id")) & (F.col("r.__text") == F.col("h.__text")), "left",
    ).select("r.__id", "r.__text", "r.text", F.sort_array("hits").alias("hits"), F.regexp_count(
        F.coalesce("r.text", F.lit("")), F.lit(TOKEN)).cast("long").alias("n_words"))
    with_words = joined.withColumn("words", F.when(F.col("hits").isNotNull(), words(F.col("text"))))
    true_hits = F.filter("hits", lambda x: F.array_join(F.slice("words", x["at"] + 1, x["length"]), " ") == x["window"])
    verified = with_words.select("__id", "__text", "n_words", true_hits.alias("hits"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["at"] + x["length"] - F.greatest(a["end"], x["at"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], x["at"] + x["length"]).alias("end")),
        lambda a: a["n"],
    )
    counted = stored(verified.select(
        "__id", "__text", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.array_distinct(F.transform("hits", lambda x: x["window"])).alias("windows"),
    ))
    pairs = counted.filter("n_hit > 0").select("__id", "__text", F.explode("windows").alias("window")).distinct()
    items = pairs.join(windows.select("window", "item").distinct(), "window").groupBy("__id", "__text").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    return counted.alias("c").join(
        items.alias("i"), F.col("c.__id").eqNullSafe(F.col("i.__id")) & (F.col("c.__text") == F.col("i.__text")), "left",
    ).select("c.__id", "c.__text", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``: one row per row of ``docs``."""
    return find_hits(docs, benchmark, **options).select(
        F.col("__id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` in which no window of the benchmark occurs, columns as they are."""
    hit = find_hits(docs, benchmark, **options).filter("n_hit > 0").select("__id", "__text").distinct()
    return keep_rows(docs, hit, "left_anti")
