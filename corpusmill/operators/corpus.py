"""Content deduplication, page order, counts and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from corpusmill.functions.text import content_hash
from corpusmill.lineage import cut


def dedup_content(
    pages: DataFrame, on: str = "content", by: Sequence[str] = (), order: Sequence[str] = ("depth", "url"),
    key: str = "page_id",
) -> DataFrame:
    """Keep the first page, in ``order``, of every distinct content.

    An aggregation by hash instead of a ranking window: copies combine before the shuffle, so
    content that a third of all pages share is one row per task, not one giant partition. Only keys
    and hashes are grouped; the pages themselves, which ``key`` names (within ``by``), join the winners.
    """
    narrow = pages.select(*by, *dict.fromkeys([*order, key]), content_hash(F.col(on)).alias("_hash"))
    first = narrow.groupBy(*by, "_hash").agg(F.min_by(key, F.struct(*order, key)).alias(key))
    return pages.join(first.select(*by, key), [*by, key], "left_semi")


def duplicate_groups(
    pages: DataFrame, on: str = "content", by: Sequence[str] = (), order: Sequence[str] = ("depth", "url"),
    keep: str = "url",
) -> DataFrame:
    """``by, hash, n, kept``: contents found more than once, and the page that is kept."""
    hashed = pages.select(*by, *dict.fromkeys([*order, keep]), content_hash(F.col(on)).alias("hash"))
    return (
        hashed.groupBy(*by, "hash")
        .agg(F.count("*").alias("n"), F.min_by(keep, F.struct(*order)).alias(f"kept_{keep}"))
        .filter("n > 1")
    )


def page_count(pages: DataFrame, by: str = "site") -> DataFrame:
    """``site, pages``."""
    return pages.groupBy(by).agg(F.count("*").alias("pages"))


def order_pages(
    pages: DataFrame, by: Sequence[str] = ("site",), order: Sequence[str] = ("depth", "url"), name: str = "ord",
) -> DataFrame:
    """Number the pages of each site from 1 in the order depth, URL.

    A ranking window would sort a whole site in one task. Here the rows are range-partitioned
    by site and order, numbered within their partition, and shifted by the number of earlier
    rows of the site; only one small row per site and partition is ranked by a window. The sorted
    rows are checkpointed, because the numbering must not change between its two readers:
    pass narrow rows and join wide ones by key.
    """
    by, order = list(by), list(order)
    ranged = pages.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    numbered = cut(ranged.withColumn("_row", F.monotonically_increasing_id())).withColumns({
        "_part": F.shiftrightunsigned("_row", 33),
        "_index": F.col("_row").bitwiseAND((1 << 33) - 1),
    })
    blocks = numbered.groupBy(*by, "_part").agg(F.min("_index").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return numbered.join(offsets, by + ["_part"]).select(
        *pages.columns, (F.col("_before") + F.col("_index") - F.col("_first") + 1).alias(name)
    )


def milestones(ordered: DataFrame, every: int = 10) -> DataFrame:
    """Every tenth processed page; number the pages before dropping duplicates."""
    return ordered.filter(F.col("ord") % every == 0)


def crawl_summary(pages: DataFrame, length: str = "content_length") -> DataFrame:
    """``site, depth, pages, content_length`` with totals per site and overall (NULL depth, site)."""
    return pages.rollup("site", "depth").agg(
        F.count("*").alias("pages"), F.sum(length).alias("content_length"),
        F.grouping_id().alias("total_level"),
    )


def site_status(starts: DataFrame, pages: DataFrame, kept: DataFrame) -> DataFrame:
    """``site, start_urls, failed_starts, pages, status`` per site.

    ``starts`` are (site, url) roots, ``pages`` the fetched (site, url), ``kept`` the pages in the
    corpus. Status: ``all start URLs failed``, ``no pages to aggregate``, ``partial`` or ``ok``.
    """
    fetched = pages.select("site", "url", F.lit(True).alias("found")).distinct()
    roots = (
        starts.select("site", "url").distinct().join(fetched, ["site", "url"], "left").groupBy("site")
        .agg(F.count("*").alias("start_urls"), F.count_if(F.col("found").isNull()).alias("failed_starts"))
    )
    counts = kept.groupBy("site").agg(F.count("*").alias("pages"))
    joined = roots.join(counts, "site", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    return joined.withColumn(
        "status",
        F.when(F.col("failed_starts") == F.col("start_urls"), "all start URLs failed")
        .when(F.col("pages") == 0, "no pages to aggregate")
        .when(F.col("failed_starts") > 0, "partial")
        .otherwise("ok"),
    )
