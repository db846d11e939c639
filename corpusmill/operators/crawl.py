"""Least depths in link graphs of any depth.

The first rounds go link by link; a round moves only its distinct candidates. What was visited is kept in levels like a log-structured
store: every round's pages are a table, and a table is merged with the one before it once that is not much larger. So there are
only logarithmically many tables at any time, each row is written logarithmically often, and the plan of a round does not grow.

Where links go deeper than that, what is left are mostly corridors: pages that can be entered from one page only, or from one on either side.
They are contracted before the rounds go on. A link ``a -> b`` continues the only other link that enters ``a``, if there is just one; pointers from each
link to the one it continues are doubled, so after a logarithm of their length all links know their head, the page that can be
entered in several ways, and the distance from it. Rounds then go from head to head, and where many follow each other, several hops at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from corpusmill.lineage import cut
from corpusmill.skew import with_classes


# The most hops from head to head of one round; a round costs much the same however few pages it reaches.
_HOPS = 8
# The most hops of one plan: the driver keeps and reports plans, and longer ones save nothing from here on.
_HOPS_PLANNED = 4


class Levels:
    """``by, url, depth`` in tables of falling size, all partitioned by their key."""

    def __init__(self, key: Sequence[str], partitions: int):
        self.key, self.partitions, self.tables = list(key), partitions, []

    def add(self, table: DataFrame, rows: int) -> None:
        """Take in a stored table; of one page the least depth counts."""
        self.tables.append((rows, table))
        while len(self.tables) > 1 and self.tables[-2][0] <= 2 * self.tables[-1][0]:
            (_, a), (_, b) = self.tables[-2:]
            merged = cut(a.unionByName(b).groupBy(*self.key).agg(F.min("depth").alias("depth")).repartition(self.partitions, *self.key))
            self.tables[-2:] = [(merged.count(), merged)]

    def without(self, candidates: DataFrame) -> DataFrame:
        """Candidates that are in none of the tables."""
        return reduce(lambda df, level: df.join(level[1], self.key, "left_anti"), self.tables, candidates)

    def improved(self, candidates: DataFrame) -> DataFrame:
        """Candidates (with ``depth``) that are in none of the tables, or deeper there."""
        for _, table in self.tables:
            known = table.select(*self.key, F.col("depth").alias("_known"))
            candidates = candidates.join(known, self.key, "left").filter("_known IS NULL OR depth < _known").drop("_known")
        return candidates

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t for _, t in self.tables]).groupBy(*self.key).agg(F.min("depth").alias("depth"))


def crawl_depths(
    pages: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int, start_depth: int = 1,
    by: Sequence[str] = (), partitions: int | None = None, plain_rounds: int = 12,
) -> DataFrame:
    """``by, url, depth``: pages reachable from the starts, with their least depth.

    Pages of a depth below ``max_depth`` expand. ``pages`` are those that can be kept (allowed
    domain, content found); others neither count nor expand. ``by`` (for instance ``site``)
    keeps several crawls apart.

    Candidates are made distinct first, so a target of very many links collapses before it is shuffled. Edges and pages are
    checkpointed once, partitioned by their join keys, into ``partitions`` (the session's number of shuffle partitions unless given;
    about one for every few million edges). After ``plain_rounds`` rounds corridors are contracted.
    """
    by = list(by)
    key = [*by, "url"]
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = cut(edges.filter("src <> dst").select(*by, "src", "dst").distinct().repartition(n, *by, "src"))
    known = cut(pages.select(*key).distinct().repartition(n, *key))
    frontier = cut(
        starts.select(*key).distinct().join(known, key, "left_semi").select(*key, F.lit(start_depth).cast("long").alias("depth")))
    visited = Levels(key, n)
    rows = frontier.count()
    visited.add(frontier, rows)
    depth = start_depth
    while rows and depth < max_depth and depth - start_depth < plain_rounds:
        depth += 1
        candidates = (
            frontier.select(*by, F.col("url").alias("src")).join(edges, [*by, "src"])
            .select(*by, F.col("dst").alias("url")).distinct()
        )
        frontier = cut(visited.without(candidates.join(known, key, "left_semi")).select(*key, F.lit(depth).cast("long").alias("depth")))
        rows = frontier.count()
        if rows:
            visited.add(frontier, rows)
    found = visited.all()
    if rows and depth < max_depth:
        fresh = cut(visited.without(known))
        found = found.unionByName(_deep(fresh, edges, frontier, max_depth, by, n))
    return found.select(*key, F.col("depth").cast("int").alias("depth"))


def _deep(fresh: DataFrame, edges: DataFrame, frontier: DataFrame, max_depth: int, by: list[str], n: int) -> DataFrame:
    """``by, url, depth`` of the pages of ``fresh`` that are reached from ``frontier``."""
    key = [*by, "url"]
    links = _corridors(*_open_links(fresh, edges, frontier, by), frontier, by)
    # heads among the pages to be reached, and the links between heads
    heads = links.select(*by, F.col("head").alias("url")).distinct().join(fresh, key, "left_semi")
    hops = links.join(heads.withColumnRenamed("url", "dst"), [*by, "dst"], "left_semi").groupBy(*by, "head", "dst").agg(F.min("steps").alias("steps"))
    # what is reached may also stay where it is, so that several hops in a row find all that fewer of them find
    stay = heads.select(*by, F.col("url").alias("head"), F.col("url").alias("dst"), F.lit(0).cast("long").alias("steps"))
    hops = cut(hops.unionByName(stay).repartition(n, *by, "head"))
    reached = Levels(key, n)
    changed, rows, rounds = cut(frontier.repartition(n, *key)), frontier.count(), 0
    while rows:
        reached.add(changed, rows)
        candidates = changed
        for hop in range(1, min(1 << (rounds // 4), _HOPS) + 1):
            candidates = candidates.withColumnRenamed("url", "head").join(hops, [*by, "head"]).groupBy(*by, F.col("dst").alias("url")).agg(
                F.min(F.col("depth") + F.col("steps")).alias("depth")).filter(F.col("depth") < max_depth)
            if hop % _HOPS_PLANNED == 0:
                candidates = cut(candidates)
        changed = cut(reached.improved(candidates).select(*key, "depth"))
        rows = changed.count()
        rounds += 1
    at = cut(reached.all())
    counts = links.groupBy(*by, "head").agg(F.count("*").alias("n"))
    headed = cut(at.withColumnRenamed("url", "head").join(counts, [*by, "head"]))
    return with_classes(links, headed, [*by, "head"], "n").groupBy(*by, F.col("dst").alias("url")).agg(
        F.min(F.col("depth") + F.col("steps")).alias("depth")).filter(F.col("depth") <= max_depth)


def _open_links(fresh: DataFrame, edges: DataFrame, frontier: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links between pages of ``fresh``, and into it from ``frontier``; and what enters each of their sources: how many (``n``), the first and the last."""
    key = [*by, "url"]
    sources = fresh.select(*key).unionByName(frontier.select(*key)).withColumnRenamed("url", "src")
    left = cut(edges.join(sources, [*by, "src"], "left_semi"))
    targets = cut(left.groupBy(*by, "dst").agg(F.count("*").alias("n")).join(fresh.select(*by, F.col("url").alias("dst")), [*by, "dst"]))
    inner = cut(with_classes(left, targets, [*by, "dst"], "n"))
    entered = inner.groupBy(*by, "dst").agg(F.count("*").alias("n"), F.min("src").alias("first"), F.max("src").alias("last"))
    return inner, entered


def _corridors(links: DataFrame, entered: DataFrame, frontier: DataFrame, by: list[str]) -> DataFrame:
    """``by, head, dst, steps``: for every link's target the page where its corridor begins, and how far that is.

    Of a source with one other way in, the link continues that way; one that is a start or has several is a head. A source that can only be
    entered from the target itself leads nowhere new, and so do rings that nothing enters: their links are left out.
    """
    ways = entered.withColumnRenamed("dst", "src")
    starts = frontier.select(*by, F.col("url").alias("src"), F.lit(True).alias("start"))
    sources = cut(links.groupBy(*by, "src").agg(F.count("*").alias("out")).join(ways, [*by, "src"], "left").join(starts, [*by, "src"], "left"))
    told = with_classes(links, sources, [*by, "src"], "out")
    back = F.col("dst").isin(F.col("first"), F.col("last"))
    others = F.coalesce("n", F.lit(0)) - F.when(back & (F.col("n") <= 2), 1).otherwise(0)
    other = F.when(F.col("first") == F.col("dst"), F.col("last")).otherwise(F.col("first"))
    marked = cut(told.select(
        *by, "src", "dst", F.when(F.col("start") | (others > 1), F.col("src")).alias("head"), other.alias("before"), F.lit(1).cast("long").alias("steps"),
        (F.coalesce("start", F.lit(False)) | (others > 0)).alias("leads"),
    ).filter("leads").drop("leads"))
    done = [marked.filter("head IS NOT NULL").drop("before")]
    # a link that is not at its head yet points at the one it continues: (from, to)
    pending = cut(marked.filter("head IS NULL").select(*by, "src", "dst", "steps", F.col("before").alias("from"), F.col("src").alias("to")))
    rounds = pending.count().bit_length() + 1
    while rounds and not pending.isEmpty():
        rounds -= 1
        nothing = F.lit(None).cast("string")
        state = pending.withColumn("head", nothing).unionByName(reduce(DataFrame.unionByName, done).withColumns({"from": nothing, "to": nothing}))
        # several links may continue one: that is met by their number, like every key that can be hot
        wanted = pending.groupBy(*by, "from", "to").agg(F.count("*").alias("n"))
        met = cut(wanted.join(state.select(
            *by, F.col("src").alias("from"), F.col("dst").alias("to"), "head", F.col("steps").alias("more"), F.col("from").alias("from2"), F.col("to").alias("to2"),
        ), [*by, "from", "to"]))
        moved = cut(with_classes(pending, met, [*by, "from", "to"], "n").select(
            *by, "src", "dst", (F.col("steps") + F.col("more")).alias("steps"), "head", F.col("from2").alias("from"), F.col("to2").alias("to")))
        done.append(moved.filter("head IS NOT NULL").select(*by, "src", "dst", "head", "steps"))
        pending = moved.filter("head IS NULL").drop("head")
    return cut(reduce(DataFrame.unionByName, done).select(*by, "head", "dst", "steps"))
