"""Site specifications as a table: defaults, validation, derivation from a URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import urls as U
from corpusmill.functions.dialect import is_valid
from corpusmill.functions.text import parse_size, title_case
from corpusmill.operators.select import DEFAULT_CONTENT, DEFAULT_TITLE

SCHEMA = (
    "name string, base_url string, output_file string, start_urls array<string>, "
    "follow_patterns array<string>, ignore_patterns array<string>, "
    "selectors struct<title:string, content:string, exclude:array<string>>, "
    "max_depth int, concurrency int, delay double, generate_toc boolean, sanitize_html boolean, "
    "include_metadata boolean, preserve_images boolean, max_file_size string, allowed_domains array<string>"
)

# Path sections followed from a documentation URL.
DOC_SECTIONS = ("docs", "documentation", "guide", "guides", "tutorial", "tutorials", "reference",
                "api", "cli", "learn")

# Patterns never followed from a URL.
IGNORE_PATTERNS = (
    r".*\.(jpg|jpeg|png|gif|svg|css|js|ico|woff|woff2|ttf|eot|pdf|zip|tar|gz)$",
    r".*/edit.*$",
    r".*/settings.*$",
    r".*/login.*$",
    r".*/logout.*$",
    r".*/signin.*$",
    r".*/signup.*$",
    r".*/register.*$",
    r".*/contact.*$",
    r".*/support.*$",
    r".*/pricing.*$",
    r".*/about.*$",
    r".*/careers.*$",
    r".*/jobs.*$",
    r".*/legal.*$",
    r".*/terms.*$",
    r".*/privacy.*$",
    r".*github\.com.*$",
    r".*twitter\.com.*$",
    r".*linkedin\.com.*$",
    r".*facebook\.com.*$",
    r".*youtube\.com.*$",
    r".*discord\.(gg|com).*$",
    r".*slack\.com.*$",
    r".*/admin.*$",
    r".*/dashboard.*$",
    r".*/account.*$",
    r".*/profile.*$",
    r".*/user/.*$",
    r".*/playground.*$",
    r".*/editor.*$",
    r".*/sandbox.*$",
)

# Selectors used when only a URL is given.
URL_TITLE = "h1, title, .page-title, .doc-title, [data-testid='page-title']"
URL_CONTENT = (
    "main, article, .content, .documentation, .docs, #content, .main-content, .doc-content, "
    ".docs-content, .documentation-content, .guide-content, .tutorial-content, .reference-content, "
    ".api-content, .markdown-body, .docusaurus_skipToContent_node, .nextra-content, "
    ".vuepress-content, .gitbook-content, .notion-page-content, .sphinx-content, [role='main'], "
    "[data-content], .page-content, .post-content, .entry-content, .single-content, #main-content, "
    "#primary-content, body"
)
URL_EXCLUDE = (
    "nav", "header", "footer", ".navigation", ".sidebar", ".toc", ".table-of-contents", ".menu", ".nav",
    ".navbar", ".topbar", ".breadcrumb", ".breadcrumbs", ".edit-link", ".edit-page", ".edit-this-page",
    ".feedback", ".prev-next", ".pagination", ".page-nav", ".site-nav", ".social", ".share", "script",
    "style", "noscript", ".highlight", ".code-toolbar", ".advertisement", ".ads", ".ad", ".promo",
    ".banner", ".cookie", ".comments", ".disqus", ".utterances", ".giscus", ".social-share", ".search",
    ".search-box", ".search-form", ".newsletter", ".subscribe", ".cmdklaunch_wrapper__KrfZL",
    ".mobile-menu_root__PX9iM", ".toggle_mobileMenuToggle__W5y02", ".header_header__TSZx7",
    "[data-testid='header']", ".DocSearch", ".algolia-docsearch", ".version-switcher", ".lang-switcher",
    ".theme-switcher", ".locale-switcher",
)

# Fixed value: what a domain looks like.
_DOMAIN = r"^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"


def _default(c: str, value) -> Column:
    """A value where the column is NULL, zero or empty."""
    zero = "" if isinstance(value, str) else 0
    return F.when(F.coalesce(F.col(c) == zero, F.lit(True)), F.lit(value)).otherwise(F.col(c))


def with_defaults(specs: DataFrame) -> DataFrame:
    """Fill in unset values and add ``max_file_size_bytes`` (NULL for a bad size)."""
    filled = specs.withColumns({
        "max_depth": _default("max_depth", 5).cast("int"),
        "concurrency": _default("concurrency", 3).cast("int"),
        "delay": _default("delay", 1.0).cast("double"),
        "max_file_size": _default("max_file_size", "10MB"),
        "selectors": F.struct(
            _default("selectors.title", DEFAULT_TITLE).alias("title"),
            _default("selectors.content", DEFAULT_CONTENT).alias("content"),
            F.coalesce("selectors.exclude", F.array().cast("array<string>")).alias("exclude"),
        ),
        **{a: F.coalesce(a, F.array().cast("array<string>"))
           for a in ("start_urls", "follow_patterns", "ignore_patterns", "allowed_domains")},
        **{f: F.coalesce(f, F.lit(False))
           for f in ("generate_toc", "sanitize_html", "include_metadata", "preserve_images")},
    })
    return filled.withColumn("max_file_size_bytes", parse_size(F.col("max_file_size")))


def _first_error(array: str, error) -> Column:
    """The first non-NULL ``error(element, index)``."""
    found = F.transform(F.col(array), lambda x, i: error(x, i))
    return F.try_element_at(F.array_compact(found), F.lit(1))


def pattern_error(pattern: Column, index: Column, field: str) -> Column:
    """NULL for a pattern that the dialect accepts."""
    return F.when(
        ~is_valid(pattern),
        F.concat(F.lit(f"invalid {field}["), index.cast("string"), F.lit("] '"), pattern, F.lit("'")),
    )


def _indexed(field: str, i: Column) -> Column:
    return F.concat(F.lit(field + "["), i.cast("string"), F.lit("]"))


def merge_equal_names(specs: DataFrame) -> DataFrame:
    """One specification per name: the first by base URL, with the start URLs of all."""
    rest = [c for c in specs.columns if c not in ("name", "start_urls")]
    starts = F.array_sort(F.array_distinct(F.flatten(F.collect_list("start_urls"))))
    merged = specs.groupBy("name").agg(F.min_by(F.struct(*rest), F.struct("base_url", "output_file")).alias("first"), starts.alias("start_urls"))
    return merged.select("name", "start_urls", "first.*").select(*specs.columns)


def spec_errors(specs: DataFrame) -> DataFrame:
    """``name, error``: the first rule each specification breaks, NULL when it is valid."""
    return with_error(specs).select("name", "error")


def with_error(specs: DataFrame) -> DataFrame:
    """Add ``error``, the first rule each specification breaks."""

    def domain_error(d: Column, i: Column) -> Column:
        return F.when(d == "", F.concat(_indexed("allowed_domains", i), F.lit(" cannot be empty"))).when(
            (F.length(d) < 3) | ~d.rlike(_DOMAIN),
            F.concat(F.lit("invalid domain format in "), _indexed("allowed_domains", i), F.lit(": '"), d, F.lit("'")),
        )

    def number(c: str, text: str) -> Column:
        return F.concat(F.lit(f"{c} {text}, got "), F.col(c).cast("string"))

    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    error = F.coalesce(
        F.when(empty("name"), F.lit("name is required")),
        U.url_error(F.coalesce("base_url", F.lit("")), "base_url"),
        F.when(empty("output_file"), F.lit("output_file is required")),
        F.when(F.coalesce(F.size("start_urls"), F.lit(0)) < 1,
               F.lit("start_urls is required and must contain at least one URL")),
        _first_error("start_urls", lambda u, i: U.url_error(u, _indexed("start_urls", i))),
        _first_error("follow_patterns", lambda p, i: pattern_error(p, i, "follow_pattern")),
        _first_error("ignore_patterns", lambda p, i: pattern_error(p, i, "ignore_pattern")),
        F.when(F.coalesce("max_depth", F.lit(0)) <= 0, number("max_depth", "must be greater than 0")),
        F.when(F.coalesce("concurrency", F.lit(0)) <= 0, number("concurrency", "must be greater than 0")),
        F.when(F.col("delay") < 0,
               F.concat(F.lit("delay must be non-negative, got "), F.format_string("%.6f", F.col("delay")))),
        _first_error("allowed_domains", domain_error),
    )
    return specs.withColumn("error", error)


def specs_from_urls(urls: DataFrame, max_depth: int = 8, concurrency: int = 3) -> DataFrame:
    """One specification per row of ``urls`` (column ``url``), with everything derived from the URL."""
    url = U.with_default_scheme(F.col("url"))
    host = U.url_hostname(url)
    pattern_host = F.replace(host, F.lit("."), F.lit("\\."))

    def follow(section: str) -> Column:
        return F.concat(F.lit("^https?://"), pattern_host, F.lit(section + "/.*"))

    everything = F.array(follow(""))
    sections = F.array(*[follow("/" + s) for s in DOC_SECTIONS])
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    return urls.select(
        F.concat(title_case(host), F.lit(" Documentation")).alias("name"),
        F.concat(U.url_scheme(url), F.lit("://"), U.url_authority(url)).alias("base_url"),
        U.output_name(url).alias("output_file"),
        F.array(url).alias("start_urls"),
        F.when(url.contains("/docs"), F.concat(everything, sections)).otherwise(everything).alias("follow_patterns"),
        texts(IGNORE_PATTERNS).alias("ignore_patterns"),
        F.struct(
            F.lit(URL_TITLE).alias("title"), F.lit(URL_CONTENT).alias("content"), texts(URL_EXCLUDE).alias("exclude")
        ).alias("selectors"),
        F.lit(max_depth).alias("max_depth"), F.lit(concurrency).alias("concurrency"), F.lit(0.8).alias("delay"),
        F.lit(True).alias("generate_toc"), F.lit(True).alias("sanitize_html"),
        F.lit(True).alias("include_metadata"), F.lit(False).alias("preserve_images"),
        F.lit("10MB").alias("max_file_size"), F.array(host).alias("allowed_domains"),
    )
