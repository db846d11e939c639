"""The whole job: pages and specifications in, ordered page tables and documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.functions.dialect import any_of
from corpusmill.lineage import release, store
from corpusmill.operators.corpus import order_pages, site_status
from corpusmill.operators.document import assemble
from corpusmill.operators.crawl import crawl_depths
from corpusmill.operators.links import assign_site, dedup_urls, follow_edges, start_pages
from corpusmill.operators.markdown import convert, with_metadata
from corpusmill.operators.rules import longest_chain, rules, selector_problem
from corpusmill.operators.specs import merge_equal_names, with_defaults, with_error
from corpusmill.operators.tokens import by_page, html_partitions
from corpusmill.functions.text import content_hash
from corpusmill.skew import with_classes
from corpusmill.sources.pages import write_corpus

SITE_KEYS = ("site", "profile", "page_id")


def checked_specs(specs: DataFrame) -> DataFrame:
    """Specifications, one per name, with defaults, ``profile`` (a number for the way pages are cut up) and ``error``."""
    filled = with_error(with_defaults(merge_equal_names(specs)))
    size = F.when(F.col("max_file_size_bytes").isNull(), F.lit("invalid max_file_size"))
    profile = F.xxhash64(F.to_json(F.struct("selectors", "sanitize_html", "preserve_images")))
    return filled.withColumns({"error": F.coalesce("error", size, selector_problem(F.col("selectors"))), "profile": profile})


def split_specs(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Specifications that can be built, and ``name, error`` of the others."""
    checked = store(checked_specs(specs))
    return checked.filter("error IS NULL"), checked.filter("error IS NOT NULL").select("name", "error")


def locate(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """``site, profile, page_id, url``: the pages of every site, one per URL."""
    sites = assign_site(pages.select("page_id", "url"), specs)
    profiles = specs.select(F.col("name").alias("site"), "profile")
    return dedup_urls(sites, by=("site",)).join(profiles, "site").select(*SITE_KEYS, "url")


def convert_sites(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """``site, profile, page_id, url, title, content_length, body, links, base, body_hash`` of every page with content.

    Sites are assigned on narrow rows, which also get the rules of their profile; html joins them by page, the way the token
    pipeline wants it distributed, is moved once and taken apart once, however many profiles there are: titles, bodies and links come
    out of one pass. The driver learns one number, the length of the longest selector chain.
    """
    narrow = store(locate(pages, specs))
    counts = narrow.groupBy("profile").agg(F.count("*").alias("n"))
    own = specs.dropDuplicates(["profile"]).select("profile", rules(F.col("selectors")).alias("rules"), "sanitize_html", "preserve_images")
    steps = specs.agg(F.max(longest_chain(F.col("selectors")))).first()[0] or 1
    ruled = with_classes(narrow, store(own.join(counts, "profile")), ["profile"], "n")
    # a page counts once for every site that has it; what is summed is its size, so that html itself is moved only once
    sizes = narrow.join(pages.select("page_id", F.octet_length("html").alias("size")), "page_id")
    n = html_partitions(sizes, F.col("size"))
    html = pages.select("page_id", "html")
    converted = convert(ruled.join(by_page(html, "page_id", n) if n else html, "page_id"), keys=SITE_KEYS, links=True, rules=steps, partitions=n)
    return converted.withColumn("body_hash", content_hash(F.col("body")))


def site_edges(converted: DataFrame, specs: DataFrame) -> DataFrame:
    """``site, src, dst``: the links every site would follow."""
    links = converted.select("site", "url", "base", F.explode("links").alias("href"))
    rules = specs.select(
        F.col("name").alias("site"), any_of(F.col("follow_patterns")).alias("follow"), any_of(F.col("ignore_patterns")).alias("ignore"), "allowed_domains")
    return follow_edges(links.join(rules, "site"), F.col("follow"), F.col("ignore"), F.col("allowed_domains"), carry=("site",))


def _reached(pages: DataFrame, converted: DataFrame, specs: DataFrame, start_depth: int) -> DataFrame:
    """``site, page_id, url, depth`` of the pages within each site's depth."""
    limits = specs.select(F.col("name").alias("site"), "max_depth")
    narrow = converted.select("site", "page_id", "url")
    if "depth" in pages.columns:
        found = narrow.join(pages.select("page_id", "depth"), "page_id")
    else:
        deepest = limits.agg(F.max("max_depth")).first()[0] or start_depth
        depths = crawl_depths(narrow.select("site", "url"), site_edges(converted, specs), start_pages(specs), deepest, start_depth, by=("site",))
        found = narrow.join(depths, ["site", "url"])
    return found.join(limits, "site").filter(F.col("depth") <= F.col("max_depth")).select("site", "page_id", "url", "depth")


def corpus_pages(pages: DataFrame, specs: DataFrame, dedup_on: str = "rendered", start_depth: int = 1) -> DataFrame:
    """``site, ord, depth, url, title, content``: the pages of every document, in order.

    Depth is the ``depth`` column of ``pages`` if there is one, else the least number of links
    from a start page, and pages out of reach are left out. ``dedup_on`` is ``rendered`` (text
    as written, metadata included) or ``body``. Invalid specifications are left out: :func:`split_specs` names them.
    """
    valid, _ = split_specs(specs)
    return ordered_pages(pages, valid, store(convert_sites(pages, valid)), dedup_on, start_depth)


def ordered_pages(pages: DataFrame, specs: DataFrame, converted: DataFrame, dedup_on: str, start_depth: int) -> DataFrame:
    """``site, ord, depth, url, title, content`` out of what :func:`convert_sites` made of ``pages``."""
    flags = specs.select(F.col("name").alias("site"), "include_metadata")
    reached = _reached(pages, converted, specs, start_depth)
    written = F.when(F.col("include_metadata"), with_metadata(F.col("body"), F.col("url"), F.col("title"), F.col("depth"))).otherwise(F.col("body"))
    rendered = converted.select("site", "page_id", "body_hash").join(reached, ["site", "page_id"]).join(flags, "site")
    # metadata names the URL, and a site has each URL once; so bodies need not be read to see that such texts differ
    named = F.col("include_metadata") if dedup_on == "rendered" else F.lit(False)
    hashed = rendered.select("site", "page_id", "depth", "url", F.when(named, F.col("url")).otherwise(F.col("body_hash")).alias("hash"))
    kept = hashed.groupBy("site", "hash").agg(F.min(F.struct("depth", "url", "page_id")).alias("first")).select("site", "first.*")
    ordinals = order_pages(kept, order=("depth", "url", "page_id"))
    bodies = converted.select("site", "page_id", "title", "body").join(ordinals, ["site", "page_id"]).join(flags, "site")
    return bodies.select("site", "ord", "depth", "url", "title", written.alias("content"))


def build_corpus(pages: DataFrame, specs: DataFrame, generated_at: str, **options) -> DataFrame:
    """``site, part, chunk, markdown``: the documents of all sites."""
    return assemble(corpus_pages(pages, specs, **options), with_defaults(merge_equal_names(specs)), generated_at)


def publish(pages: DataFrame, specs: DataFrame, path: str, generated_at: str, dedup_on: str = "rendered", start_depth: int = 1) -> None:
    """Build and write everything: documents by output file, ``_status`` of every site and ``_rejected`` specifications.

    Intermediate tables are removed at the end.
    """
    valid, rejected = split_specs(specs)
    converted = store(convert_sites(pages, valid))
    ordered = store(ordered_pages(pages, valid, converted, dedup_on, start_depth))
    write_corpus(assemble(ordered, valid, generated_at), f"{path}/documents", valid)
    site_status(start_pages(valid), converted, ordered).write.mode("overwrite").parquet(f"{path}/_status")
    rejected.write.mode("overwrite").parquet(f"{path}/_rejected")
    release(pages.sparkSession)
