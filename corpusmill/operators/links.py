"""Link extraction, site assignment and crawl audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from corpusmill.functions import urls as U
from corpusmill.functions.html import attr
from corpusmill.functions.regex import let, trim_space
from corpusmill.operators.select import DEFAULT_CONTENT, base_href, page_stream
from corpusmill.operators.tokens import KEYS, source_text


def extract_links(
    pages: DataFrame, content: str = DEFAULT_CONTENT, exclude: Sequence[str] = (),
    keys: Sequence[str] = KEYS, require_content: bool = True, carry: Sequence[str] = ("url",),
) -> DataFrame:
    """``keys, carry, href, pos, base``: links left on a page once excluded elements are gone, and its ``<base href>``.

    Links outside the content count, links in excluded parts of the content do not. With
    ``require_content`` a page without content has no links.
    """
    rows = page_stream(pages, title=None, content=content, exclude=exclude, keys=keys, carry=carry, links=True)
    whole = W.partitionBy(*keys)
    rows = rows.withColumn("base", base_href().over(whole))
    if require_content:
        visible = (F.col("part") == "content") & ~F.col("boundary") & (trim_space(source_text()) != "")
        rows = rows.withColumn("has_content", F.bool_or(visible).over(whole)).filter("has_content")
    return rows.filter("part = 'link'").select(
        *keys, *carry, attr("href").alias("href"), F.col("open_pos").alias("pos"), "base"
    )


def follow_edges(
    links: DataFrame, follow=(), ignore=(), domains=(), carry: Sequence[str] = (),
) -> DataFrame:
    """``carry, src, dst``: the distinct links that would be visited from each page.

    Resolution, then the legal, ignore and follow filters, then the domain test, before the only shuffle.
    A column ``base`` (what ``<base href>`` says, or NULL) takes part in the resolution.
    ``follow`` and ``ignore`` are lists, or columns of compiled patterns (``any_of``) when links of several sites are
    mixed; ``domains`` is a list or an array column.
    """
    # A generator, because filters are not pushed through one: a link is resolved once, not once per condition.
    target = U.resolve_url(F.col("url"), F.col("href"))
    if "base" in links.columns:
        own = F.when(F.col("base").isNull(), F.col("url")).otherwise(F.coalesce(U.resolve_url(F.col("url"), F.col("base")), F.col("url")))
        target = let(own, lambda b: U.resolve_url(b, F.col("href")))
    target = F.explode(F.array_compact(F.array(target)))
    resolved = links.select(
        *carry, F.col("url").alias("src"), target.alias("dst"),
        *[c for c in (follow, ignore, domains) if not isinstance(c, (list, tuple))],
    )
    kept = resolved.filter(U.should_follow(F.col("dst"), follow, ignore)).filter(
        U.is_allowed_domain(F.col("dst"), domains)
    )
    return kept.select(*carry, "src", "dst").distinct()


def missing_pages(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """``url, links``: link targets that are not in the page table, with their number of links.

    Targets are counted before the join, so a target of very many links is one row in it.
    """
    targets = edges.groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("links"))
    return targets.join(pages.select("url"), "url", "left_anti")


def assign_site(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """The pages with ``site`` added, once for every specification that allows the page's domain.

    Works on distinct hosts: each host meets the specifications through the domains it lies
    under, an equi-join. A specification without domains takes every page (key ``*``).
    """
    host = U.url_authority(F.col("url"))
    hosts = pages.select(host.alias("host")).distinct()
    keyed = hosts.select(
        "host",
        F.explode(
            F.array_append(U.host_suffixes(F.concat(F.lit("https://"), F.col("host"))), F.lit("*"))
        ).alias("domain"),
    )
    domains = specs.select(
        F.col("name").alias("site"),
        F.explode(
            F.when(F.size("allowed_domains") > 0, F.col("allowed_domains")).otherwise(F.array(F.lit("*")))
        ).alias("domain"),
    )
    sites = keyed.join(domains, "domain").select("host", "site").distinct()
    return pages.withColumn("host", host).join(sites, "host").select(*pages.columns, "site")


def start_pages(specs: DataFrame) -> DataFrame:
    """``site, url`` of the crawl roots; only the domain test applies to them."""
    roots = specs.select(F.col("name").alias("site"), "allowed_domains", F.explode("start_urls").alias("url"))
    return roots.filter(U.is_allowed_domain(F.col("url"), F.col("allowed_domains"))).select("site", "url").distinct()


def dedup_urls(
    pages: DataFrame, order: Sequence[str] = ("page_id",), by: Sequence[str] = (), key: str = "page_id",
) -> DataFrame:
    """One row per exact URL (within ``by``): the first in ``order``. No URL is normalized.

    An aggregation of keys with map-side combining, so a URL with very many copies stays cheap and wide
    columns are not sorted; whole rows meet the winners in a join.
    """
    first = pages.groupBy(*by, "url").agg(F.min_by(key, F.struct(*order)).alias(key))
    return pages.join(first, [*by, "url", key], "left_semi")


def skip_report(pages: DataFrame, domains, key: str = "page_id") -> DataFrame:
    """``url, reason, pages``: rows a crawl would skip, by the first rule that applies.

    ``pages`` has ``url``, a key and ``has_content``. The reasons are disallowed_domain,
    already_visited (a later copy of a URL) and no_content_found.
    """
    allowed = U.is_allowed_domain(F.col("url"), domains)
    per_url = pages.groupBy("url").agg(
        F.count("*").alias("n"), F.min_by("has_content", key).alias("has_content")
    )
    entry = lambda cond, reason, n: F.when(
        cond & (n > 0), F.struct(F.lit(reason).alias("reason"), n.alias("pages"))
    )
    reasons = F.array_compact(F.array(
        entry(~allowed, "disallowed_domain", F.col("n")),
        entry(allowed, "already_visited", F.col("n") - 1),
        entry(allowed & ~F.col("has_content"), "no_content_found", F.lit(1).cast("bigint")),
    ))
    return per_url.select("url", F.explode(reasons).alias("r")).select("url", "r.reason", "r.pages")
