from pyspark.sql import functions as F

from conftest import column
from corpusmill.functions.dialect import any_of
from corpusmill.functions import urls

SITE = "https://example.com"


def check(spark, cases, fn):
    got = column(spark, [(a,) for a, _ in cases], "c string", fn(F.col("c")))
    assert got == [b for _, b in cases]


def test_allowed_domain(spark):
    rows = [
        (["example.com"], SITE + "/page", True),
        (["example.com"], "https://docs.example.com/page", True),
        (["example.com"], "https://maliciousexample.com/page", False),
        ([], "https://anywhere.com/page", True),
        (["example.com"], "not-a-url", False),
        (["example.com"], "https://example.com:8080/", False),
        (["example.com:8080"], "https://example.com:8080/", True),
        (["example.com"], "https://EXAMPLE.com/", False),
        (["example.com"], "https://user:pw@example.com/", True),
    ]
    got = column(spark, rows, "d array<string>, u string, e boolean",
                 urls.is_allowed_domain(F.col("u"), F.col("d")))
    assert got == [r[2] for r in rows]
    for domains, url, expected in rows:
        assert column(spark, [(url,)], "u string", urls.is_allowed_domain(F.col("u"), domains)) == [expected]


def test_host_suffixes(spark):
    check(spark, [("https://a.b.c/x", ["a.b.c", "b.c", "c"]), ("nothing", [])], urls.host_suffixes)


def test_legal_page(spark):
    check(spark, [
        (SITE + "/privacy", True), (SITE + "/terms", True), (SITE + "/about", True),
        (SITE + "/docs/api", False), (SITE + "/blog/post", False), (SITE + "/careers", True),
        (SITE + "/blog", False), (SITE + "/PRIVACY?x=1", True), (SITE + "/privacy-policy", False),
        (SITE + "/a/status#b", True), (SITE + "/privacy\n", False),
    ], urls.is_legal_page)


def test_should_follow(spark):
    docs = r"^https://example\.com/docs/.*"
    rows = [
        ([], [], SITE + "/privacy", False),
        ([], [r".*\.jpg$"], SITE + "/image.jpg", False),
        ([docs], [], SITE + "/docs/guide", True),
        ([docs], [], SITE + "/blog/post", False),
        ([], [], SITE + "/anything", True),
        ([docs, "blog"], ["q9", ".*/edit.*$"], SITE + "/blog/post", True),
        ([docs, "blog"], ["q9", ".*/edit.*$"], SITE + "/blog/editorial", False),
        ([], [r"a|zzz", "b"], "https://h.org/q", True),
        ([], [r"a|zzz", "b"], "https://h.org/zzz", False),
    ]
    got = column(spark, rows, "f array<string>, i array<string>, u string, e boolean",
                 urls.should_follow(F.col("u"), any_of(F.col("f")), any_of(F.col("i"))))
    assert got == [r[3] for r in rows]
    for follow, ignore, url, expected in rows:
        assert column(spark, [(url,)], "u string",
                      urls.should_follow(F.col("u"), follow, ignore)) == [expected]


def test_parts(spark):
    check(spark, [("HTTPS://u@h.org:81/x?q#f", "https"), ("h.org/x", ""), ("mailto:a@b", "mailto")],
          urls.url_scheme)
    check(spark, [("https://u@h.org:81/x", "h.org:81"), ("https://h.org?x", "h.org"), ("/x", "")],
          urls.url_authority)
    check(spark, [("https://h.org:81/x", "h.org"), ("https://[::1]:80/", "::1"), ("x", "")],
          urls.url_hostname)


def test_resolve_url(spark):
    base = "http://a/b/c/d;p?q"
    cases = [  # RFC 3986 section 5.4, fragments dropped
        ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"),
        ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"),
        ("g?y", "http://a/b/c/g?y"), ("#s", None), ("g#s", "http://a/b/c/g"),
        ("g?y#s", "http://a/b/c/g?y"), (";x", "http://a/b/c/;x"), (".", "http://a/b/c/"),
        ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"),
        ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"),
        ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."),
        ("..g", "http://a/b/c/..g"), ("./g/.", "http://a/b/c/g/"), ("g/../h", "http://a/b/c/h"),
        ("", None), (None, None), ("http://x/a/../b#f", "http://x/b"),
        ("HTTP://x/y", "http://x/y"), ("mailto:a@b", "mailto:a@b"), (" /t ", "http://a/t"),
        ("/für x", "http://a/f%C3%BCr%20x"), ("/a?ü", "http://a/a?ü"),
    ]
    got = column(spark, [(base, h) for h, _ in cases], "b string, h string",
                 urls.resolve_url(F.col("b"), F.col("h")))
    assert got == [e for _, e in cases]
    assert column(spark, [("https://h.org", "x")], "b string, h string",
                  urls.resolve_url(F.col("b"), F.col("h"))) == ["https://h.org/x"]


def test_url_error(spark):
    cases = [
        ("", "test_url cannot be empty"), ("ht tp://invalid url", "invalid test_url"),
        ("example.com/path", "test_url must include scheme"), ("https://", "test_url must include host"),
        ("ftp://example.com", "test_url must use http or https scheme"),
        (SITE + "/path", None), ("http://example.com", None), ("https://h/%zz", "invalid test_url"),
        ("https://h:8o/", "invalid test_url"), ("https://h:80/a b", None), ("not-a-url", "test_url must include scheme"),
    ]
    got = column(spark, [(u,) for u, _ in cases], "u string", urls.url_error(F.col("u"), "test_url"))
    for (_, want), have in zip(cases, got):
        assert (have is None) if want is None else have.startswith(want)


def test_title_from_url(spark):
    check(spark, [
        (SITE + "/api-reference", "Api Reference"), (SITE + "/docs/getting-started", "Getting Started"),
        (SITE + "/api/", "Api"), (SITE + "/", "Example.com"), ("x_y", "X Y"), ("", "Untitled"),
        ("//", "Untitled"), ("/", "Untitled"),
    ], urls.title_from_url)


def test_naming(spark):
    check(spark, [("h.org/x", "https://h.org/x"), ("http://h", "http://h")], urls.with_default_scheme)
    check(spark, [("https://example.com:80/docs", "example-com-docs.md")], urls.output_name)
