"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusmill.functions import dialect as regexes, entities, text as X, urls as U
from corpusmill.functions.html import attr, token_text
from corpusmill.lineage import checkpoint_dir, store
from corpusmill.operators import corpus as C, crawl as R, document as D, links as L, markdown as M, select as S, specs as P
from corpusmill.operators import tokens as T
from corpusmill.plans.build import build_corpus, corpus_pages
from corpusmill.sources.pages import scan_pages, write_corpus, write_pages
from corpusmill.streaming import ingest
from corpusmill.streaming.documents import stream_documents as stream_all

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GENERATED_AT = "2025-01-02 03:04:05"
DOMAINS = ("example.com", "blog.ththan.example.net", "org")
FOLLOW = (r"^https?://[^/]*example\.(com|net)/.*", r"\?page=\d+")
IGNORE = (r".*\.html$", r".*/edit.*$", r"utm_source")
# Path endings that make the page URLs meet every URL rule.
ENDINGS = ("/privacy", "/blog", "/Terms?x=1", "/docs/api-reference", "/edit/me", "/a_b/", "/status#b",
           "/privacy-policy", "/user_guide.html", "/careers/", "", "/404")
TITLE_SUFFIXES = (" – React", " - stripe", " | The Docs", " | Big Documentation ", "", " docs Docs",
                  " This feature is available in the latest Canary", " – Vue")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return scan_pages(spark, f"{sf}/pages.parquet")


def pick(values, key: str = "page_id") -> Column:
    """A value chosen by the key, the same for every run."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def varied_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs without query and fragment, each with one of the endings."""
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return pages(spark, sf).select("page_id", F.concat(bare, pick(ENDINGS)).alias("url"))


def site_specs(spark: SparkSession) -> DataFrame:
    """Three sites that share the pages by top-level domain."""
    rows = [
        (f"{tld.title()} Docs", f"https://example.{tld}", f"{tld}.md", [f"https://example.{tld}/"], [], [],
         ("h1", "article", []), 0, 3, 1.0, True, True, True, False, "5MB", [f"example.{tld}"])
        for tld in ("com", "net", "org")
    ]
    return spark.createDataFrame(rows, P.SCHEMA)


def deep_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a depth; the table has none."""
    return pages(spark, sf).withColumn("depth", (F.col("page_id") % 4).cast("int"))


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, url, site, depth, title`` of every page."""
    located = L.assign_site(deep_pages(spark, sf), site_specs(spark))
    return S.page_titles(located, "h1", carry=("url", "site", "depth"))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, url, depth, content``: the article of every page, taken out of its html once."""
    found = S.main_content(pages(spark, sf), "article")
    return store(found.join(deep_pages(spark, sf).drop("html"), "page_id"))


# ------------------------------------------------------------ sources and sinks


@query
def page_scan(spark, sf):
    return pages(spark, sf).select("page_id", "url", F.char_length("html").alias("html_chars"))


@query
def start_pages(spark, sf):
    specs = P.specs_from_urls(pages(spark, sf).select("url"))
    # every specification whose URL has a query allows another domain, so its root is rejected
    has_query = F.col("start_urls")[0].contains("?")
    return L.start_pages(specs.withColumn(
        "allowed_domains", F.when(has_query, F.array(F.lit("elsewhere.org"))).otherwise(F.col("allowed_domains"))))


@query
def corpus_sink(spark, sf):
    out = scratch(spark)
    write_corpus(build_corpus(deep_pages(spark, sf), site_specs(spark), GENERATED_AT), out)
    lines = spark.read.text(out).select("site", F.col("value").alias("line"))
    return lines.groupBy("site", "line").agg(F.count("*").alias("copies"))


@query
def page_sink(spark, sf):
    out = scratch(spark)
    write_pages(titled(spark, sf), out)
    return spark.read.parquet(out).select("page_id", "site", "url", "title", "depth")


# ------------------------------------------------------------ URLs


@query
def url_parts(spark, sf):
    u = F.col("url")
    return varied_urls(spark, sf).select(
        "page_id", U.url_scheme(u).alias("scheme"), U.url_authority(u).alias("authority"),
        U.url_hostname(F.regexp_replace("url", "(//[^/]*)", "$1:8080")).alias("hostname"),
    )


@query
def allowed_domain(spark, sf):
    return pages(spark, sf).select("page_id", U.is_allowed_domain(F.col("url"), DOMAINS).alias("allowed"))


@query
def legal_page(spark, sf):
    return varied_urls(spark, sf).select("page_id", "url", U.is_legal_page(F.col("url")).alias("legal"))


@query
def ignore_patterns(spark, sf):
    return varied_urls(spark, sf).select("page_id", "url", U.matches_any(F.col("url"), IGNORE).alias("ignored"))


# Patterns that the dialect accepts or refuses, and where it means something else than Java.
DIALECT = (
    r"^https?://example\.(com|net)/.*", r".*\.html$", r".*/[a-z]+/\d+", r"\?page=\d+$", r"(?i)EXAMPLE\.ORG", r"[[:digit:]]{2,}", r"[a&&m]", r"[/[.]", r"\p{Greek}|\pN{3}", r"(?U)o.+?g",
    r"(?P<tld>com|org)/", r"example.{,3}com", r"\Qexample.org\E", r"\x{6F}rg", r"\157rg", r"\bth", r"[^\s/]+\z", r"(?m)^https", "", "a{1001}", "(a{100}){11}", "(?x)a b", r"\h+", "(?u)a", r"a\Z", "a(?=b)",
    r"(a)\1", "a++", "[[:foo:]]", "*a", r"[a-\d]",
)


@query
def pattern_matches(spark, sf):
    """Every pattern against every URL; NULL where the dialect refuses the pattern."""
    patterns = spark.createDataFrame([(i, p) for i, p in enumerate(DIALECT)], "k int, pattern string").withColumn(
        "c", F.when(regexes.is_valid(F.col("pattern")), regexes.compiled(F.col("pattern"))))
    urls = pages(spark, sf).select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(len(DIALECT) - 1))).alias("k"))
    return urls.join(patterns, "k").select("page_id", "pattern", regexes.found(F.col("url"), F.col("c")).alias("matched"))


@query
def follow_edges_by_site(spark, sf):
    """Links of all hosts, filtered by the patterns of each host's own specification."""
    specs = P.merge_equal_names(P.specs_from_urls(pages(spark, sf).select("url")))
    rules = specs.select(
        F.regexp_extract("base_url", "//(.*)", 1).alias("host"), regexes.any_of(F.col("follow_patterns")).alias("follow"),
        regexes.any_of(F.concat("ignore_patterns", F.array(F.lit(r".*/th\w+$"), F.lit("/[A-Z]")))).alias("ignore"))
    links = nav_links(spark, sf).withColumn("host", U.url_authority(F.col("url"))).join(rules, "host")
    return L.follow_edges(links, F.col("follow"), F.col("ignore"))


@query
def follow_patterns(spark, sf):
    return varied_urls(spark, sf).select("page_id", "url", U.follows(F.col("url"), FOLLOW).alias("followed"))


@query
def should_follow(spark, sf):
    return varied_urls(spark, sf).select(
        "page_id", "url", U.should_follow(F.col("url"), FOLLOW, IGNORE).alias("follow"))


def nav_links(spark, sf):
    return L.extract_links(pages(spark, sf), "article", ["nav"])


@query
def absolute_link(spark, sf):
    word = F.expr("substring(href, 2)")
    refs = {
        "root": F.col("href"), "plain": word, "up": F.concat(F.lit("../"), word),
        "here": F.concat(F.lit("./"), word, F.lit("#x")), "query": F.concat(F.lit("?q="), word),
        "fragment": F.concat(F.lit("#"), word), "host": F.concat(F.lit("//h.org/"), word),
        "absolute": F.concat(F.lit("HTTPS://h.org/a/../b?"), word),
    }
    forms = F.array(*[F.struct(F.lit(k).alias("form"), v.alias("ref")) for k, v in refs.items()])
    return nav_links(spark, sf).select("page_id", "pos", "url", F.explode(forms).alias("f")).select(
        F.col("page_id"), F.col("pos"), "f.form", U.resolve_url(F.col("url"), F.col("f.ref")).alias("target"))


@query
def url_validity(spark, sf):
    broken = (
        F.when(F.col("page_id") % 7 == 0, "")
        .when(F.col("page_id") % 7 == 1, F.regexp_replace("url", "^http", "ht tp"))
        .when(F.col("page_id") % 7 == 2, F.regexp_replace("url", "^https?://", ""))
        .when(F.col("page_id") % 7 == 3, F.regexp_replace("url", "//.*$", "//"))
        .when(F.col("page_id") % 7 == 4, F.regexp_replace("url", "^https?", "ftp"))
        .when(F.col("page_id") % 7 == 5, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/%zz")))
        .otherwise(F.col("url"))
    )
    checked = pages(spark, sf).select("page_id", broken.alias("url"))
    return checked.select("page_id", U.url_error(F.col("url"), "base_url").alias("error"))


@query
def title_from_url(spark, sf):
    return varied_urls(spark, sf).select("page_id", U.title_from_url(F.col("url")).alias("title"))


@query
def default_scheme(spark, sf):
    shorter = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return pages(spark, sf).select("page_id", U.with_default_scheme(shorter).alias("url"))


@query
def output_name(spark, sf):
    return pages(spark, sf).select("page_id", U.output_name(F.col("url")).alias("output_file"))


@query
def url_dedup(spark, sf):
    p = pages(spark, sf).select("page_id", "url")
    later = p.select((F.col("page_id") + 1_000_000).alias("page_id"), F.regexp_replace("url", "#.*$", "").alias("url"))
    return L.dedup_urls(p.unionByName(later))


# ------------------------------------------------------------ strings


def raw_titles(spark, sf):
    title = entities.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    return pages(spark, sf).select("page_id", F.concat(title, pick(TITLE_SUFFIXES)).alias("title"))


@query
def clean_title(spark, sf):
    return raw_titles(spark, sf).select("page_id", X.clean_title(F.col("title")).alias("title"))


@query
def title_case(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.title_case(F.col("text")).alias("title"))


@query
def anchor(spark, sf):
    return raw_titles(spark, sf).select("page_id", X.anchor(F.col("title")).alias("anchor"))


@query
def tidy_markdown(spark, sf):
    ragged = F.replace(F.replace("text", F.lit(". "), F.lit(". \n\n \t\n\n")), F.lit(", "), F.lit(",\t\n"))
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", X.tidy_markdown(F.concat(F.lit("\n\n"), ragged, F.lit("\n \n"))).alias("markdown"))


@query
def trim_body(spark, sf):
    padded = F.concat(F.lit(" \n\t"), F.col("text"), F.lit("  \n"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.trim_body(padded).alias("body"))


@query
def parse_size(spark, sf):
    size = F.concat(F.col("n_chars").cast("string"), pick(("", "KB", "MB", "GB", "kb", "x"), "doc_id"))
    size = F.when(F.col("doc_id") % 11 == 0, F.substring(size, -2, 2)).otherwise(size)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.parse_size(size).alias("bytes"))


@query
def content_hash(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


# ------------------------------------------------------------ HTML


@query
def html_tokens(spark, sf):
    return T.tokenize(pages(spark, sf)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "kind", "tag", "text",
        F.when(F.col("tag") == "a", attr("href")).alias("href"),
    )


@query
def html_elements(spark, sf):
    return T.elements(pages(spark, sf)).select(
        "page_id", F.col("open_pos").cast("bigint").alias("open_pos"),
        F.col("close_pos").cast("bigint").alias("close_pos"), "tag",
        F.array_join("classes", " ").alias("classes"), F.col("attrs")["href"].alias("href"),
    )


@query
def css_select(spark, sf):
    found = S.select(pages(spark, sf), "nav a[href], div.ad, h1")
    return found.select(
        "page_id", F.col("open_pos").cast("bigint").alias("open_pos"), "tag", F.col("attrs")["href"].alias("href"))


@query
def exclude_subtrees(spark, sf):
    return S.main_content(pages(spark, sf), "body", ["nav", ".ad", "footer", "h1"])


@query
def main_content(spark, sf):
    return S.main_content(pages(spark, sf), S.DEFAULT_CONTENT)


@query
def drop_empty(spark, sf):
    """Pages whose article was blanked are left out."""
    blank = F.regexp_replace("html", r"(?s)<article>.*?</article>", "<article> \n</article>")
    p = pages(spark, sf).withColumn("html", F.when(F.col("page_id") % 3 == 0, blank).otherwise(F.col("html")))
    return S.main_content(p, "article").select("page_id", F.char_length("content").alias("content_chars"))


@query
def page_title(spark, sf):
    return S.page_titles(pages(spark, sf), "h1")


@query
def page_title_fallback(spark, sf):
    """No match for the selector: the title element counts; without one, Untitled."""
    bare = F.regexp_replace("html", r"(?s)<title>.*?</title>", "")
    p = pages(spark, sf).withColumn("html", F.when(F.col("page_id") % 5 == 0, bare).otherwise(F.col("html")))
    return S.page_titles(p, ".page-title")


@query
def page_title_all_matches(spark, sf):
    return S.page_titles(pages(spark, sf), P.URL_TITLE)


@query
def sanitize_html(spark, sf):
    return M.sanitize(pages(spark, sf), "article")


@query
def sanitize_navigation(spark, sf):
    return M.sanitize(pages(spark, sf), "nav, .ad")


@query
def decode_entities(spark, sf):
    tokens = T.tokenize(pages(spark, sf)).filter("kind = 'text'")
    return tokens.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"),
        token_text().alias("text"))


# ------------------------------------------------------------ Markdown


@query
def to_markdown(spark, sf):
    return M.convert(pages(spark, sf), content="article").select("page_id", "title", "body")


@query
def to_markdown_navigation(spark, sf):
    return M.convert(pages(spark, sf), content="nav").select("page_id", "body")


@query
def to_markdown_absolute_links(spark, sf):
    return M.convert(pages(spark, sf), content="nav", absolute_links=True).select("page_id", "body")


@query
def metadata_header(spark, sf):
    t = titled(spark, sf)
    return t.select("page_id", M.metadata_header(F.col("url"), F.col("title"), F.col("depth")).alias("header"))


# Inline elements that end inside each other, around a page's own URL.
CROSSED = (
    "a<b>{}<i>c</b>d</i>e",
    "<b>x<a href='/t'>{}</b>z</a>w",
    "<span><b>x<b>y<i>{}</b>w</span></b>q</i>",
    "<i>u<s>{}<b>v</i>w</s></b><b><i></b>n</i>",
)


def crossed(spark, sf):
    """Pages with a paragraph of crossing elements behind what their article holds."""
    text = F.regexp_replace("url", "[^A-Za-z0-9]", "")
    forms = F.array(*[F.concat(F.lit(before), text, F.lit(after)) for before, after in (c.split("{}") for c in CROSSED)])
    extra = F.concat(F.lit("<p>"), F.element_at(forms, (F.col("page_id") % len(CROSSED) + 1).cast("int")), F.lit("</p></article>"))
    return pages(spark, sf).select("page_id", "url", F.replace("html", F.lit("</article>"), extra).alias("html"), extra.alias("extra"))


@query
def to_markdown_crossed(spark, sf):
    return M.convert(crossed(spark, sf), content="article").select("page_id", "title", "body")


TABLES = (
    "<table><tr><th colspan=2>{}<tr><td>a<td>b</table>",
    "<table><tr><td rowspan=2>{}<td>1<td>2<tr><td>3<tr><td>4<td>5</table>",
    "<table><tr><td>{}<td colspan=9>b<tr><td>c<td>d<td>e</table>",
)


@query
def to_markdown_tables(spark, sf):
    """Pages with a table whose cells span columns and rows behind what their article holds."""
    text = F.regexp_replace("url", "[^A-Za-z0-9]", "")
    forms = F.array(*[F.concat(F.lit(before), text, F.lit(after)) for before, after in (t.split("{}") for t in TABLES)])
    extra = F.concat(F.element_at(forms, (F.col("page_id") % len(TABLES) + 1).cast("int")), F.lit("</article>"))
    p = pages(spark, sf).withColumn("html", F.replace("html", F.lit("</article>"), extra))
    return M.convert(p, content="article").select("page_id", "title", "body")


@query
def sanitize_crossed(spark, sf):
    alone = crossed(spark, sf).select("page_id", F.concat(F.lit("<article>"), "extra").alias("html"))
    return M.sanitize(alone, "article")


@query
def html_elements_crossed(spark, sf):
    alone = crossed(spark, sf).select("page_id", F.concat(F.lit("<article>"), "extra").alias("html"))
    return T.elements(alone).select(
        "page_id", F.col("open_pos").cast("bigint").alias("open_pos"), F.col("close_pos").cast("bigint").alias("close_pos"), "explicit_close", "tag")


# ------------------------------------------------------------ links


@query
def extract_links(spark, sf):
    return nav_links(spark, sf).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


@query
def extract_links_excluded(spark, sf):
    """Links of the list are excluded from the content, on every other page."""
    p = pages(spark, sf).withColumn(
        "html", F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<nav>"), F.lit('<nav class="top">')))
        .otherwise(F.col("html")))
    return L.extract_links(p, "body", [".top"]).groupBy("page_id").agg(F.count("*").alias("links"))


@query
def follow_edges(spark, sf):
    return L.follow_edges(nav_links(spark, sf), [r"/[a-z]", "/[A-Z]"], [r".*/th.*$"], ["example.com", "example.net"])


def numbered_edges(spark, sf):
    """Links between pages: each page links to three others, by page number."""
    p = pages(spark, sf).select("page_id", "url")
    to = p.select("page_id", F.col("url").alias("src"), F.explode(F.array(
        F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2, F.floor(F.col("page_id") / 3))).alias("to"))
    return to.join(p.select(F.col("page_id").alias("to"), F.col("url").alias("dst")), "to").select("src", "dst")


def derived_edges(spark, sf):
    """Links by page number, and the pages' own."""
    return numbered_edges(spark, sf).unionByName(L.follow_edges(nav_links(spark, sf)))


@query
def crawl_depths(spark, sf):
    """Pages whose article was blanked have no content: they neither count nor expand."""
    blank = F.regexp_replace("html", r"(?s)<article>.*?</article>", "<article> \n</article>")
    p = pages(spark, sf).withColumn("html", F.when(F.col("page_id") % 13 == 6, blank).otherwise(F.col("html")))
    # content and links come out of one reading of html
    kept = store(M.convert(p, content="article", exclude=["nav"], links=True).select("page_id", "url", "links", "base"))
    real = L.follow_edges(kept.select("url", "base", F.explode("links").alias("href")))
    starts = p.filter("page_id % 100 = 0").select("url")
    return R.crawl_depths(kept, numbered_edges(spark, sf).unionByName(real), starts, 6)


@query
def crawl_depths_chain(spark, sf):
    """Every page links to the one before and the one after it and to the first, and every third to one far ahead: as deep as there are pages."""
    p = pages(spark, sf).select("page_id", "url")
    ahead = F.when(F.col("page_id") % 3 == 0, F.col("page_id") + 40)
    to = p.select(F.col("url").alias("src"), F.explode(F.array_compact(F.array(F.col("page_id") - 1, F.col("page_id") + 1, F.lit(0).cast("long"), ahead))).alias("to"))
    edges = to.join(p.select(F.col("page_id").alias("to"), F.col("url").alias("dst")), "to").select("src", "dst")
    # a page in fifty cannot be kept, so that only links ahead lead on
    return R.crawl_depths(p.filter("page_id % 50 <> 49"), edges, p.filter("page_id = 0").select("url"), 2**31 - 1)


@query
def missing_pages(spark, sf):
    return L.missing_pages(derived_edges(spark, sf), pages(spark, sf))


@query
def assign_site(spark, sf):
    specs = site_specs(spark).unionByName(
        P.merge_equal_names(P.specs_from_urls(pages(spark, sf).select("url"))))
    return L.assign_site(pages(spark, sf).select("page_id", "url"), specs)


@query
def skip_report(spark, sf):
    p = pages(spark, sf).select("page_id", F.regexp_replace("url", r"[?#].*$|/$", "").alias("url"))
    flags = p.withColumn("has_content", F.col("page_id") % 4 != 0)
    again = flags.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1_000_000)
    return L.skip_report(flags.unionByName(again), ["example.com", "example.org"])


# ------------------------------------------------------------ corpus


@query
def content_dedup(spark, sf):
    return C.dedup_content(articles(spark, sf), "content").select("page_id", "url", "depth")


@query
def content_dedup_rendered(spark, sf):
    """The rendered text names its URL, so equal bodies of different URLs all stay."""
    a = articles(spark, sf).withColumn(
        "rendered", M.with_metadata(F.col("content"), F.col("url"), F.lit("t"), F.col("depth")))
    return C.dedup_content(a, "rendered").select("page_id", "url", "depth")


@query
def duplicate_groups(spark, sf):
    return C.duplicate_groups(articles(spark, sf), "content")


@query
def duplicate_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    return C.duplicate_groups(docs, "text", order=("doc_id",), keep="doc_id")


@query
def page_count(spark, sf):
    docs = L.assign_site(articles(spark, sf), site_specs(spark))
    return C.page_count(C.dedup_content(docs, "content", by=("site",)))


@query
def page_order(spark, sf):
    located = L.assign_site(deep_pages(spark, sf).drop("html"), site_specs(spark))
    return C.order_pages(located.select("site", "depth", "url"))


@query
def progress_milestones(spark, sf):
    located = L.assign_site(deep_pages(spark, sf).drop("html"), site_specs(spark))
    return C.milestones(C.order_pages(located.select("site", "depth", "url")))


@query
def crawl_summary(spark, sf):
    docs = L.assign_site(articles(spark, sf), site_specs(spark))
    return C.crawl_summary(docs.withColumn("content_length", F.octet_length("content").cast("bigint"))).select(
        "site", "depth", "pages", "content_length", F.col("total_level").cast("bigint").alias("total_level"))


@query
def site_status(spark, sf):
    """One site per host: its starts are its pages and, for some, a page that does not exist."""
    p = pages(spark, sf).select("page_id", U.url_authority(F.col("url")).alias("site"), "url")
    lost = p.filter("page_id % 9 = 0").select("site", F.concat(F.col("url"), F.lit("/lost")).alias("url"))
    only_lost = lost.select(F.concat(F.lit("x."), F.col("site")).alias("site"), "url")
    empty = p.select(F.concat(F.lit("y."), F.col("site")).alias("site"), "url").filter("url LIKE '%.html'")
    starts = p.select("site", "url").unionByName(lost).unionByName(only_lost).unionByName(empty)
    fetched = p.select("site", "url").unionByName(empty)
    return C.site_status(starts, fetched, p)


# ------------------------------------------------------------ documents


def ordered_titles(spark, sf):
    t = store(titled(spark, sf))
    ordinals = C.order_pages(t.select("site", "page_id", "depth", "url"), order=("depth", "url", "page_id"))
    return t.join(ordinals.select("site", "page_id", "ord"), ["site", "page_id"])


@query
def document_header(spark, sf):
    specs = P.with_defaults(site_specs(spark))
    located = L.assign_site(pages(spark, sf).select("page_id", "url"), specs)
    return D.doc_header(C.page_count(located), specs, GENERATED_AT)


@query
def table_of_contents(spark, sf):
    return D.toc_lines(ordered_titles(spark, sf)).select("site", "ord", "line")


@query
def section_heading(spark, sf):
    t = varied_urls(spark, sf).select(
        "page_id", "url", (F.col("page_id") % 9).cast("int").alias("depth"), pick(("Untitled", "", "Some Title")).alias("title"))
    return t.select(
        "page_id", D.section_title(F.col("title"), F.col("url")).alias("title"),
        D.section_heading(F.col("title"), F.col("url"), F.col("depth")).alias("heading"))


@query
def sections(spark, sf):
    docs = corpus_pages(deep_pages(spark, sf), site_specs(spark))
    return D.sections(docs).select("site", "ord", "section")


@query
def documents_md(spark, sf):
    return build_corpus(deep_pages(spark, sf), site_specs(spark), GENERATED_AT)


@query
def documents_md_body_dedup(spark, sf):
    docs = corpus_pages(deep_pages(spark, sf), site_specs(spark), dedup_on="body")
    return docs.select("site", "ord", "depth", "url", "title")


@query
def documents_md_duplicates(spark, sf):
    """Copies of pages under the same URLs change nothing."""
    p = deep_pages(spark, sf)
    return build_corpus(p.unionByName(p.withColumn("page_id", F.col("page_id") + 1_000_000)), site_specs(spark), GENERATED_AT)


@query
def documents_md_profiles(spark, sf):
    """Every site has selectors of its own, and two more specifications cannot be built."""
    exclude, title = F.when(F.col("name") == "Net Docs", F.array(F.lit("h1"))).otherwise(F.col("selectors.exclude")), F.col("selectors.title")
    own = site_specs(spark).withColumn("selectors", F.struct(
        F.when(F.col("name") == "Org Docs", "title").otherwise(title).alias("title"), F.col("selectors.content").alias("content"), exclude.alias("exclude")))
    one = own.filter("name = 'Com Docs'")
    bad = one.withColumns({"name": F.lit("bad"), "concurrency": F.lit(-1)}).unionByName(one.withColumns({
        "name": F.lit("odd"), "selectors": F.struct(F.lit("a > b").alias("title"), F.lit("p").alias("content"), F.col("selectors.exclude").alias("exclude"))}))
    return corpus_pages(deep_pages(spark, sf), own.unionByName(bad))


def linked_pages(spark, sf):
    """Pages that each link to three others, beside their own links."""
    p = pages(spark, sf)
    to = p.select("page_id", F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2, F.floor(F.col("page_id") / 3))).alias("to"))
    links = to.join(p.select(F.col("page_id").alias("to"), "url"), "to").groupBy("page_id").agg(
        F.array_join(F.collect_list(F.concat(F.lit('<a href="'), "url", F.lit('">to</a>'))), "").alias("more"))
    whole = T.by_page(p, "page_id", T.html_partitions(p))
    return whole.join(links, "page_id", "left").select("page_id", "url", F.concat("html", F.coalesce("more", F.lit(""))).alias("html"))


def crawled_specs(spark, sf):
    """Three sites that start at the first page of every host; no depth ends the crawl before all linked pages are reached."""
    first = L.assign_site(pages(spark, sf).select("page_id", "url"), site_specs(spark)).groupBy("site", U.url_hostname(F.col("url"))).agg(F.min_by("url", "page_id").alias("url"))
    starts = first.groupBy(F.col("site").alias("name")).agg(F.collect_set("url").alias("start_urls"))
    return site_specs(spark).drop("start_urls").join(starts, "name").withColumn("max_depth", F.lit(2**31 - 1))


@query
def documents_md_crawled(spark, sf):
    """From links to ordered pages."""
    return corpus_pages(linked_pages(spark, sf), crawled_specs(spark, sf)).select("site", "ord", "depth", "url", "title")


@query
def entity_references(spark, sf):
    """Numbers with any count of leading zeros, with and without the semicolon, and HTML 5 names."""
    k = F.col("page_id") % 26 + 65
    text = F.concat(F.lit("&#"), F.repeat(F.lit("0"), (F.col("page_id") % 20).cast("int")), k.cast("string"), F.lit("; &#"), k.cast("string"),
                    F.lit(" &#x000"), F.hex(k), F.lit("; &check; &#150; &#99999999999; &#"), F.repeat(F.lit("9"), (F.col("page_id") % 9 + 7).cast("int")), F.lit(";"))
    return pages(spark, sf).select("page_id", entities.decode_entities(text).alias("text"))


# ------------------------------------------------------------ specifications


def derived_specs(spark, sf):
    """One specification per page, with values that meet the defaults and the rules."""
    specs = P.specs_from_urls(pages(spark, sf).select("url"))
    return specs.withColumn("k", F.regexp_extract(F.col("start_urls")[0], r"/(\d+)", 1).cast("int"))


@query
def spec_defaults(spark, sf):
    s = derived_specs(spark, sf).withColumns({
        "max_depth": (F.col("k") % 3).cast("int"), "concurrency": (F.col("k") % 2).cast("int"),
        "delay": (F.col("k") % 4).cast("double"),
        "max_file_size": pick(("", "5MB", "10KB", "big"), "k"),
        "selectors": F.struct(
            F.when(F.col("k") % 2 == 0, "").otherwise("h2").alias("title"), F.lit("").alias("content"),
            F.lit(None).cast("array<string>").alias("exclude")),
    })
    d = P.with_defaults(s)
    return d.select(
        F.col("start_urls")[0].alias("url"), "max_depth", "concurrency", "delay", "max_file_size",
        "max_file_size_bytes", F.col("selectors.title").alias("title_selector"),
        F.col("selectors.content").alias("content_selector"), F.size("selectors.exclude").alias("n_exclude"))


@query
def spec_errors(spark, sf):
    k = F.col("k") % 12
    url = F.col("start_urls")[0]
    s = derived_specs(spark, sf).withColumns({
        "name": F.when(k == 0, "").otherwise(url),
        "base_url": F.when(k == 1, "not-a-url").otherwise(F.col("base_url")),
        "output_file": F.when(k == 2, "").otherwise(F.col("output_file")),
        "start_urls": F.when(k == 3, F.array().cast("array<string>")).when(k == 4, F.array(url, F.lit("not-a-url")))
        .otherwise(F.col("start_urls")),
        "follow_patterns": F.when(k == 5, F.array(F.lit("ok"), F.lit("[invalid regex"))).otherwise(F.col("follow_patterns")),
        "ignore_patterns": F.when(k == 6, F.array(F.lit("blog(?!/)"))).otherwise(F.col("ignore_patterns")),
        "max_depth": F.when(k == 7, -1).otherwise(F.col("max_depth")),
        "concurrency": F.when(k == 8, 0).otherwise(F.col("concurrency")),
        "delay": F.when(k == 9, -1.0).otherwise(F.col("delay")),
        "allowed_domains": F.when(k == 10, F.array(F.lit("example.com"), F.lit(""))).otherwise(F.col("allowed_domains")),
        "url": url,
    })
    bad_domain = F.when(k == 11, F.array(F.lit("invalid-domain"))).otherwise(F.col("allowed_domains"))
    checked = P.spec_errors(s.withColumn("allowed_domains", bad_domain))
    return checked.select(F.coalesce("name", F.lit("")).alias("name"), "error")


@query
def specs_from_urls(spark, sf):
    u = varied_urls(spark, sf)
    short = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    s = P.specs_from_urls(u.select(short.alias("url")))
    return s.select(
        "name", "base_url", "output_file", F.col("start_urls")[0].alias("start_url"),
        F.array_join("follow_patterns", " ").alias("follow"), F.size("ignore_patterns").alias("n_ignore"),
        F.sha2(F.array_join("ignore_patterns", " "), 256).alias("ignore_hash"),
        F.sha2(F.array_join("selectors.exclude", " "), 256).alias("exclude_hash"), F.col("selectors.title").alias("title_selector"),
        F.col("selectors.content").alias("content_selector"), F.array_join("allowed_domains", " ").alias("domains"),
        "max_depth", "delay", "generate_toc", "preserve_images")


# ------------------------------------------------------------ streaming


@query
def stream_pages(spark, sf):
    out = scratch(spark)
    source = ingest.page_source(spark, sf, "pages.parquet")
    clean = lambda batch: M.convert(batch, content="article").select("page_id", "url", "title", "body")
    ingest.stream_pages(source, clean, out, dedup_on="body").awaitTermination()
    ingest.stream_first_copies(spark, out).awaitTermination()
    return spark.read.parquet(f"{out}/distinct").select("url", "title", "body", "content_hash")


@query
def stream_content_dedup(spark, sf):
    out = scratch(spark)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.readStream.schema(schema).parquet(ingest.table_path(sf, "documents.parquet"))
    ingest.stream_distinct_hashes(docs, "text", out).awaitTermination()
    return spark.read.parquet(f"{out}/hashes").select("content_hash")


def in_batches(df: DataFrame, batch: Column, n: int, out: str) -> int:
    """Files that a stream reads one batch after the other; returns how many files every batch has.

    A batch is written by as many tasks as its rows are read by. Streams take a fixed number of files at a time, so batches of fewer files than the
    largest one get empty ones.
    """
    spark, marked = df.sparkSession, f"{scratch(df.sparkSession)}/marked"
    df.withColumn("_batch", batch).write.partitionBy("_batch").parquet(marked)
    found = spark.read.schema(StructType([*df.schema.fields, StructField("_batch", IntegerType())])).parquet(marked)
    batches = [found.filter(F.col("_batch") == i).drop("_batch") for i in range(n)]
    files = max(b.rdd.getNumPartitions() for b in batches) or 1
    empty = spark.createDataFrame([], df.schema).coalesce(1)
    for i, rows in enumerate(batches):
        rows.write.mode("append").parquet(out)
        written = len(spark.read.schema(df.schema).parquet(out).inputFiles())
        for _ in range(files * (i + 1) - written):
            empty.write.mode("append").parquet(out)
    return files


@query
def stream_content_dedup_bounded(spark, sf):
    """Twelve days of documents, a batch each; contents are remembered two days, and until the clock has passed that."""
    out = scratch(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    dated = docs.withColumn("day", F.col("doc_id") % 12).withColumn("at", F.timestamp_add("DAY", F.col("day").cast("int"), F.lit("2025-01-01").cast("timestamp")))
    files = in_batches(dated, F.col("day"), 12, f"{out}/in")
    stream = spark.readStream.schema("doc_id long, text string, day long, at timestamp").option("maxFilesPerTrigger", files).parquet(f"{out}/in")
    ingest.stream_recent_hashes(stream, "text", out, "at", "2 days", keep=("day",)).awaitTermination()
    return spark.read.parquet(f"{out}/hashes").select("content_hash", "day")


@query
def stream_page_counts(spark, sf):
    """Five batches, with the log folded after every second one."""
    out = scratch(spark)
    files = in_batches(pages(spark, sf), F.col("page_id") % 5, 5, f"{out}/in")
    source = ingest.page_source(spark, f"{out}/in", max_files=files).select(U.url_authority(F.col("url")).alias("site"))
    ingest.stream_counts(source, "site", out, compact_every=2).awaitTermination()
    return ingest.latest_counts(spark, out)


@query
def stream_milestones(spark, sf):
    """Pages arrive by depth, a batch each; every tenth one is a milestone."""
    out = scratch(spark)
    deep = deep_pages(spark, sf).drop("html")
    files = in_batches(deep, F.col("depth"), 4, f"{out}/in")
    source = spark.readStream.schema(deep.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/in")
    ingest.stream_progress(source, out).awaitTermination()
    return spark.read.parquet(f"{out}/milestones").select("depth", "url", "ord")


@query
def stream_documents(spark, sf):
    """The pages of all documents after three batches of linked pages."""
    out = scratch(spark)
    linked, specs = linked_pages(spark, sf), crawled_specs(spark, sf)
    files = in_batches(linked, F.col("page_id") % 3, 3, f"{out}/in")
    stream_all(ingest.page_source(spark, f"{out}/in", max_files=files), specs, out, GENERATED_AT).awaitTermination()
    return spark.read.parquet(f"{out}/ordered").select("site", "ord", "depth", "url", "title")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of three sites, from raw pages."""
    return documents_md(spark, sf)
