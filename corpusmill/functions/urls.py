"""URL predicates and scalar functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from corpusmill.functions.dialect import found
from corpusmill.functions.regex import let, replace_each, search_form
from corpusmill.functions.text import title_case

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"

# Path words that mark pages which are not documentation.
LEGAL_WORDS = (
    "privacy", "terms", "legal", "cookies", "gdpr", "about", "contact", "support", "careers",
    "jobs", "news", "press", "media", "pricing", "enterprise", "commercial", "sales", "login",
    "signup", "register", "account", "profile", "404", "error", "maintenance", "status",
)


# ---------------------------------------------------------------- parts


def url_scheme(c: Column) -> Column:
    """Lower-case scheme, or the empty string."""
    return F.lower(F.regexp_extract(c, _SCHEME, 1))


def url_authority(c: Column) -> Column:
    """Host with its port, without user information; empty when there is none."""
    return F.regexp_replace(F.regexp_extract(c, _AUTHORITY, 1), r"^.*@", "")


def url_hostname(c: Column) -> Column:
    """Host without port and without IPv6 brackets."""
    host = url_authority(c)
    return F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_extract(host, r"^([^:]*)", 1)
    )


def url_path_depth(c: Column) -> Column:
    """Number of non-empty path segments."""
    path = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


# ---------------------------------------------------------------- predicates


def is_allowed_domain(c: Column, domains: Sequence[str] | Column) -> Column:
    """True when the host (port included) is one of ``domains`` or below one; an empty list allows all."""
    host = url_authority(c)
    if not isinstance(domains, Column):
        ok = F.lit(not domains)
        for d in domains:
            ok = ok | (host == d) | host.endswith("." + d)
        return ok
    return (F.size(domains) == 0) | F.exists(
        domains, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))
    )


def host_suffixes(c: Column) -> Column:
    """Every domain the host lies under, e.g. ``a.b.c`` -> ``[a.b.c, b.c, c]``; empty without a host.

    Turns the ends-with test of :func:`is_allowed_domain` into an equality, so that many
    site specifications can be matched with an ordinary hash join.
    """
    host = url_authority(c)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tails = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tails)


def is_legal_page(c: Column) -> Column:
    """True for privacy, legal, account and other pages that are not documentation."""
    return c.rlike(r"(?i)/(" + "|".join(LEGAL_WORDS) + r")(\z|[/?#])")


def matches_any(c: Column, patterns: Sequence[str] | Column) -> Column:
    """True when at least one pattern is found anywhere in the text; False for no patterns.

    Patterns that are data come compiled, by ``any_of`` once per specification.
    """
    if isinstance(patterns, Column):
        return F.coalesce(F.exists(patterns, lambda p: found(c, p)), F.lit(False))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | c.rlike(search_form(p))
    return hit


def follows(c: Column, patterns: Sequence[str] | Column) -> Column:
    """True when there are no follow patterns or one of them is found."""
    if isinstance(patterns, Column):
        return F.coalesce(F.exists(patterns, lambda p: found(c, p)), F.lit(True))
    return matches_any(c, patterns) if patterns else F.lit(True)


def should_follow(
    c: Column, follow: Sequence[str] | Column, ignore: Sequence[str] | Column
) -> Column:
    """Not a legal page, then not ignored, then followed."""
    return ~is_legal_page(c) & ~matches_any(c, ignore) & follows(c, follow)


# ---------------------------------------------------------------- resolution


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 section 5.2.4 for an absolute path."""

    def clean(segments: Column) -> Column:
        kept = F.aggregate(
            F.slice(segments, 2, F.size(segments)),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
            ).when(s == ".", acc).otherwise(F.array_append(acc, s)),
        )
        # "/a/b/.." names the directory "/a/", so a final dot segment leaves an empty last segment.
        ending = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, ending), "/"))

    return F.when(path.startswith("/") & path.contains("/."), let(F.split(path, "/", -1), clean)).otherwise(path)


def _escape_path(path: Column) -> Column:
    """Percent-encode the characters a path may not hold literally."""
    bad = r"[^\x21-\x7E]+|[\"<>\\^`{|}]+"
    encoded = replace_each(path, bad, lambda m: F.replace(F.url_encode(m), F.lit("+"), F.lit("%20")))
    return F.when(path.rlike(bad), encoded).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page ``base``; NULL when there is nothing to visit.

    RFC 3986 resolution with the fragment removed. An empty link or a pure fragment is NULL.
    """
    ref = F.regexp_replace(F.regexp_replace(href, r"\A[\t\n\f\r ]+|[\t\n\f\r ]+\z", ""), r"(?s)#.*\z", "")
    rest = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"
    query = r"(\?[^#]*)"

    def recompose(p: Column) -> Column:
        has_host = p["absolute"] | p["ref"].startswith("//")
        only_query = ~has_host & (p["ref_path"] == "")
        directory = F.when(p["base_path"] == "", F.lit("/")).otherwise(F.regexp_extract(p["base_path"], "^(.*/)", 1))
        target = F.struct(
            F.when(p["absolute"], url_scheme(p["ref"])).otherwise(p["scheme"]).alias("scheme"),
            F.when(has_host, F.regexp_extract(p["ref"], _AUTHORITY, 1)).otherwise(p["authority"]).alias("authority"),
            F.when(only_query, p["base_path"])
            .when(has_host | p["ref"].startswith("/"), _remove_dot_segments(p["ref_path"]))
            .otherwise(_remove_dot_segments(F.concat(directory, p["ref_path"]))).alias("path"),
            F.when(only_query & (p["query"] == ""), F.regexp_extract(base, query, 1)).otherwise(p["query"]).alias("query"),
        )
        return let(target, lambda t: F.concat(
            t["scheme"], F.lit("://"), t["authority"], _escape_path(t["path"]), t["query"]))

    parts = F.struct(
        ref.alias("ref"),
        ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://").alias("absolute"),
        F.regexp_extract(ref, rest + "([^?#]*)", 1).alias("ref_path"),
        F.regexp_extract(ref, query, 1).alias("query"),
        F.regexp_extract(base, _SCHEME, 1).alias("scheme"),
        F.regexp_extract(base, _AUTHORITY, 1).alias("authority"),
        F.regexp_extract(base, rest + "([^?#]*)", 1).alias("base_path"),
    )
    resolved = let(
        parts,
        lambda p: F.when(p["ref"] == "", F.lit(None).cast("string"))
        .when(~p["absolute"] & p["ref"].rlike(_SCHEME), p["ref"])
        .otherwise(recompose(p)),
    )
    return F.when(href.isNotNull() & base.isNotNull(), resolved)


# ---------------------------------------------------------------- validation and naming


def url_error(c: Column, field: str | Column) -> Column:
    """NULL for a usable http(s) URL, else the message of the first rule it breaks."""
    name = F.lit(field) if isinstance(field, str) else field
    first_segment_colon = c.rlike(r"^[^/?#]*:") & ~c.rlike(_SCHEME)
    authority = F.regexp_extract(c, _AUTHORITY, 1)
    host = F.regexp_replace(authority, r"^.*@", "")
    path = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    fragment = F.regexp_extract(c, r"(?s)#(.*)\z", 1)
    bad_escape = r"%(?![0-9A-Fa-f]{2})"
    malformed = (
        c.rlike(r"[\x00-\x1F\x7F]")
        | first_segment_colon
        | host.rlike(r"[ \\^`{|}]")
        | (~host.startswith("[") & host.rlike(r":(?![0-9]*\z)"))
        | host.rlike(bad_escape)
        | path.rlike(bad_escape)
        | fragment.rlike(bad_escape)
    )
    quoted = F.concat(F.lit("'"), c, F.lit("'"))

    def msg(text: str) -> Column:
        return F.concat(name, F.lit(text), quoted)

    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.concat(name, F.lit(" cannot be empty")))
        .when(malformed, F.concat(F.lit("invalid "), name, F.lit(" "), quoted))
        .when(url_scheme(c) == "", msg(" must include scheme (http/https): "))
        .when(host == "", msg(" must include host: "))
        .when(~url_scheme(c).isin("http", "https"), msg(" must use http or https scheme: "))
    )


def title_from_url(c: Column) -> Column:
    """A heading made from the last non-empty path part."""
    parts = F.split(c, "/", -1)
    last = F.element_at(parts, -1)
    # try_element_at: a text without "/" has no part before the last.
    last = F.when(last == "", F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))).otherwise(last)
    return F.when(last == "", F.lit("Untitled")).otherwise(title_case(F.translate(last, "-_", "  ")))


def with_default_scheme(c: Column) -> Column:
    """Prepend ``https://`` when there is no scheme."""
    return F.when(c.rlike(_SCHEME), c).otherwise(F.concat(F.lit("https://"), c))


def output_name(c: Column) -> Column:
    """File name for a site's document."""
    return F.concat(F.replace(url_hostname(c), F.lit("."), F.lit("-")), F.lit("-docs.md"))
