"""Quality rules with adaptive thresholds.

Four measures of every text are summed into quantile sketches per language and source: counts per bucket of three
significant digits, which merge by adding, so partial sketches are made where the texts are and a small source falls
back to the merged sketch of its language, or of everything. A text is an outlier in a measure when it lies more than
``reach`` times the interquartile range beyond the quartiles of its group. Thresholds are then joined to the texts.

Defined results: NULL, empty and wordless texts have zero counts and fail the base rule; NULL languages and
sources form groups of their own; equal rows are judged alike; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.llm.common import WORD, keep_rows, stored, text_key

# Fixed value: characters that count as symbols.
SYMBOL = r"[#*$%&|<>]"
# Measure: least interquartile range (so that groups of nearly equal texts do not reject small deviations).
SPREAD = {"symbols": 10, "dup_lines": 120, "repeats": 160, "word_length": 15}


def repeated_words(words: Column) -> Column:
    """Number of words inside a window of three words that the text has more than once.

    ``words`` must be a column of its own (not an expression) for the windows to be cheap.
    """
    n = F.size(words)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")))


def measured(docs: DataFrame) -> DataFrame:
    """``__id, __text, lang, source`` and the base counts of every row; texts are read once."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        F.col("doc_id").alias("__id"), text_key(F.col("text")).alias("__text"), "lang", "source",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
    )
    windows = split.withColumn("windows", F.sort_array(repeated_words(F.col("words"))))
    same = lambda x, i: F.coalesce(F.get(F.col("windows"), i)["h"] == x["h"], F.lit(False))
    found = windows.withColumn("at", F.sort_array(F.transform(
        F.filter("windows", lambda x, i: same(x, i + 1) | ((i > 0) & same(x, i - 1))), lambda x: x["at"])))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(a["end"], x)).alias("n"), (x + 3).alias("end")),
        lambda a: a["n"],
    )
    counted = found.select(
        "__id", "__text", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
    )
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return counted.withColumn("base_failed", base)


def _measures() -> dict[str, Column]:
    """Whole numbers: thousandths, and tenths of a character."""
    of = lambda a, b: F.expr(f"{a} div greatest({b}, 1)")
    return {
        "symbols": of("1000 * n_symbols", "word_chars"), "dup_lines": of("1000 * n_dup_lines", "n_lines"),
        "repeats": of("1000 * n_repeat_words", "n_words"), "word_length": of("10 * word_chars", "n_words"),
    }


def bucket(value: Column) -> Column:
    """Whole numbers up to three digits as they are, larger ones to three significant digits, without an upper end."""
    width = F.pow(F.lit(10.0), F.greatest(F.length(value.cast("string")), F.lit(3)) - 3).cast("long")
    return value - F.pmod(value, width)


def sketches(rows: DataFrame) -> DataFrame:
    """``level, lang, source, measure, bucket, n`` of all groups: 0 language and source, 1 language, 2 everything."""
    each = F.array(*[
        F.struct(F.lit(name).alias("measure"), bucket(value).alias("bucket"))
        for name, value in _measures().items()
    ])
    fine = rows.filter(~F.col("base_failed")).select("lang", "source", F.inline(each)).groupBy(
        "lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    by_lang = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    return (
        fine.withColumn("level", F.lit(0))
        .unionByName(by_lang.withColumns({"level": F.lit(1), "source": none}))
        .unionByName(whole.withColumns({"level": F.lit(2), "lang": none, "source": none}))
    )


def thresholds(sketch: DataFrame, reach: int) -> DataFrame:
    """``level, lang, source, total, <measure>_low, <measure>_high`` of every group."""
    group = ("level", "lang", "source", "measure")
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*group))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    quartiles = sketch.withColumns({"upto": upto, "total": total}).groupBy(*group, "total").agg(
        quartile(1).alias("q1"), quartile(3).alias("q3"))
    out = []
    for name, spread in SPREAD.items():
        beyond = F.greatest(F.col("q3") - F.col("q1"), F.lit(spread)) * reach
        mine = F.col("measure") == name
        out += [F.max(F.when(mine, F.col("q1") - beyond)).alias(name + "_low"), F.max(F.when(mine, F.col("q3") + beyond)).alias(name + "_high")]
    return quartiles.groupBy("level", "lang", "source", "total").agg(*out)


def judged(docs: DataFrame, reach: int = 3, least_group: int = 100) -> DataFrame:
    """The base counts and ``kept`` of every row of ``docs``."""
    rows = stored(measured(docs))
    limits = stored(thresholds(sketches(rows), reach))
    bounds = [c for c in limits.columns if c.endswith(("_low", "_high"))]
    pick = lambda level, letter: limits.filter(F.col("level") == level).select(
        *([F.col("lang").alias(letter + "lang")] if level < 2 else []), *([F.col("source").alias(letter + "source")] if level < 1 else []),
        F.col("total").alias(letter + "n"), F.struct(*bounds).alias(letter + "bounds"))
    fine, lang, whole = pick(0, "f"), pick(1, "l"), limits.filter("level = 2").select(*bounds).first()
    joined = (
        rows.join(fine, F.col("lang").eqNullSafe(F.col("flang")) & F.col("source").eqNullSafe(F.col("fsource")), "left")
        .join(lang, F.col("lang").eqNullSafe(F.col("llang")), "left")
    )
    everything = F.struct(*[F.lit(whole[b] if whole else None).cast("long").alias(b) for b in bounds])
    own = F.when(F.col("fn") >= least_group, F.col("fbounds")).when(F.col("ln") >= least_group, F.col("lbounds")).otherwise(everything)
    inside = F.lit(True)
    for name, value in _measures().items():
        inside &= F.coalesce(bucket(value).between(F.col("own")[name + "_low"], F.col("own")[name + "_high"]), F.lit(True))
    return joined.withColumn("own", own).select(
        "__id", "__text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
    )


def quality(docs: DataFrame, **options) -> DataFrame:
    """``doc_id`` with base counts and verdict: one row per row of ``docs``."""
    return judged(docs, **options).withColumnRenamed("__id", "doc_id").drop("__text")


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, columns as they are."""
    return keep_rows(docs, judged(docs, **options).filter("kept").select("__id", "__text").distinct())
