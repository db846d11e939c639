"""Mixing sources to target weights by capped water-filling.

Every source wants a share of the budget in proportion to its weight, but is read at most
``max_epochs`` times. Sources whose share is above that limit stop there, and what they leave is shared
among the others by weight, until no source is above its limit.

Defined results: a NULL or empty text has size 0 and counts with its source; a NULL source is a source of
its own, the last one; rows equal in ``doc_id``, source and text are repeated equally often; an empty table
gives an empty table; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import WORD, free_name, running, stored, text_key

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, share: float, max_epochs: int) -> float:
    """The level l at which the sum of min(max_epochs * size, l * weight) is ``share`` of all sizes.

    ``sources`` has ``size, weight``. Each round is one aggregation and caps at least one more source;
    rounds end when the level caps no further source.
    """
    size = F.sum("size")
    total, weight = sources.agg(size, F.sum("weight")).first()
    if not total:
        return 0.0
    budget, level, capped = total * share, total * share / weight, 0
    cap = F.col("size") * max_epochs
    while True:
        above = cap < F.lit(level) * F.col("weight")
        n, taken, open_weight = sources.agg(
            F.count_if(above), F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))),
        ).first()
        if n == capped or not open_weight:
            return level
        capped, level = n, (budget - taken) / open_weight


def repetitions(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: str = "mix",
) -> DataFrame:
    """``__id, __source, __text, size, n, source_size, target, copies``: one row per different document.

    ``n`` is the number of equal rows it stands for and ``copies`` how often each of them is taken. A
    source of which e epochs are wanted is taken floor(e) times whole; for the rest its documents are put
    in an order seeded by their id and taken until the missing words are there, within half a document.
    """
    narrow = docs.select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), text_key(F.col("text")).alias("__text"),
        word_count(F.col("text")).alias("size"),
    )
    rows = stored(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n")))
    sizes = rows.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).withColumns(
        {"one": F.lit(1), "last": F.col("__source").isNull()})
    numbered = running(sizes, ["last", "__source"], "one", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(numbered.select("__source", "size", "place", weight.alias("weight")))
    level = water_level(sources, share, max_epochs)
    target = F.least(F.lit(float(max_epochs)) * F.col("size"), F.lit(level) * F.col("weight"))
    wanted = sources.select(
        F.col("__source").alias("s"), "place", F.col("size").alias("source_size"), target.alias("target"),
    ).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    ordered = running(
        rows.join(wanted, F.col("__source").eqNullSafe(F.col("s"))).drop("s").withColumns({
            "__words": F.col("size") * F.col("n"),
            "__key": F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("__id").cast("string"), F.lit("")))),
        }),
        ["__key", "__id", "__text"], "__words", "__before", by="place",
    )
    missing = F.col("target") - F.col("whole") * F.col("source_size")
    # so many of the equal rows are taken once more that their words come nearest to what is missing
    rest = missing - F.col("__before")
    extra = F.when(missing <= 0, 0).when(F.col("size") > 0, F.floor(rest / F.greatest("size", F.lit(1)) + 0.5)).otherwise(F.when(rest >= 0, F.col("n")).otherwise(0))
    return ordered.select(
        "__id", "__source", "__text", "size", "n", "source_size", "target", F.col("whole").alias("copies"),
        F.greatest(F.least(extra, F.col("n")), F.lit(0)).cast("long").alias("extra"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: every row of ``docs`` as often as its source's target asks, columns as they are."""
    chosen = stored(repetitions(docs, **options).filter("copies + extra > 0").select("__id", "__source", "__text", "n", "copies", "extra"))
    on = (
        docs["doc_id"].eqNullSafe(chosen["__id"]) & docs["source"].eqNullSafe(chosen["__source"])
        & (text_key(docs["text"]) == chosen["__text"])
    )
    turn = free_name(docs, "__copy")
    repeated = docs.join(chosen, on).filter(chosen["n"] == 1).select(
        *[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), (chosen["copies"] + chosen["extra"]).cast("int"))).alias(turn))
    if chosen.filter("n > 1").isEmpty():
        return repeated.drop(turn)
    # equal rows are numbered; the first ones are those taken once more
    names = [free_name(docs, c) for c in ("__group", "__order", "__one", "__times", "__more", "__place")]
    group, order, one, times, more, place = names
    equal = docs.join(chosen, on).filter(chosen["n"] > 1).select(
        *[docs[c] for c in docs.columns], F.md5(F.to_json(F.struct(chosen["__id"], chosen["__source"], chosen["__text"]))).alias(group),
        F.xxhash64(*[docs[c] for c in docs.columns]).alias(order), F.lit(1).alias(one), chosen["copies"].alias(times), chosen["extra"].alias(more))
    numbered = running(equal, [order], one, place, by=group)
    each = F.col(times) + F.when(F.col(place) < F.col(more), 1).otherwise(0)
    again = numbered.withColumn(times, each.cast("int")).filter(F.col(times) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(turn))
    return repeated.unionByName(again).drop(turn)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: one row per row of ``docs``."""
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return repetitions(docs, **options).withColumn("__row", each).select(
        F.col("__id").alias("doc_id"), "size", "source_size", "target",
        ((F.col("copies") + F.when(F.col("__row") <= F.col("extra"), 1).otherwise(0)) * F.col("size")).cast("long").alias("taken"),
    )
