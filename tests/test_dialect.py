"""The pattern dialect against another engine of it: which patterns it refuses, and what the others match."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.dialect import any_of, compiled, found, is_valid, java_form, longest_literal, runs
from corpusmill.operators import specs as P

PATTERNS = [
    # repeats
    "a{1001}", "a{1000}", "(a{100}){11}", "(a{100}){10}", "(?:(a{10}){10}){11}", "(a{2,}){501}", "a{,5}", "a{1", "{", "}", "x{2,1}", "a{0}b", "a**", "a*??", "a++", "a?+", "a{2}{3}", "x*{2}",
    "(a{2}){3}", "*a", "a|*b", "(*a)", "^*", "(?:)*", "()", "|", "a||b", "a{3", "a{2,}?", "[a-c]{2}", "(x{30}|y{40}){26}", "(x{30}|y{40}){25}",
    # escapes
    r"\h+", r"\R", r"\K", r"\e", r"\Z", r"\G", r"\cA", r"A", r"\_", r"\/", r"\-", r"\<", r"\é", r"\1", r"\12", r"\07", r"\0", r"\x41", r"\x4", r"\x{41}", r"\x{110000}", r"\x{10FFFF}", r"\Q.*\E", r"\Qa",
    r"\pL", r"\pN", r"\p{Greek}", r"\p{^Greek}", r"\P{Lu}", r"\p{Lu}", r"\p{Nope}", r"\p{greek}", r"\a\f", r"\v", r"\t", r"\s", r"\S+", r"\d\D", r"\bpage\b", r"\Bage", r"\Ahttp", r"org\z", "a\\",
    # groups and flags
    "(?x)a b", "(?u)a", "(?d)a", "(?i)HTTP", "(?i-s:HTTP)", "(?-i)a", "(?-)a", "(?)a", "(?U)a+?", "(?s).", "(?m)^a$", "(?im)^A$", "(?P<n>a)", "(?P<n>a)(?P<n>b)", "(?P<a-b>x)", "(?P<1a>x)", "(?=a)", "(?!a)",
    "(?<=a)b", "(?<!a)b", "(?>a)", "(?#c)a", "(", ")", "(a", "a)", "(?:a|b)+", "(?P=n)", "(?P>n)",
    # classes
    "[a&&b]", "[a[b]c]", "[a[b]", "[[:alpha:]]", "[[:^alpha:]]", "[[:foo:]]", "[[:word:]-]", "[]a]", "[^]a]", "[]", "[", "[z-a]", r"[a-\d]", r"[\d-z]", r"[\s/]", r"[^\s]", r"[\v]", r"[\b]", r"[\Q]", r"[\pL]", r"[^\p{Lu}]",
    r"[\x41-\x5A]", r"[\07]", "[-a]", "[a-]", "[a^]", "[^^]", "[{}]", "[(]", "[.]", r"[\]]", "[&]", "[#-%]", r"[\w.-]+@", "]",
    # what specifications hold
    r"^https?://example\.com/.*", r".*\.(jpg|jpeg|png|css|js)$", r".*/edit.*$", r".*discord\.(gg|com).*$", r"/docs/(v\d+|latest)/", "^https?://[^/]*example\\.(com|net)/.*", r"\?page=\d+", ".*", "^.*$", "^$", "$", "a.c", r"a\.c",
    r"^https://example\.com/docs$", r"docs?/(a|b)?c", "(a|b|)(c|d)x?", r"\.html$", r"colou?r", "(?i).*LOGIN.*", r"a\$", r"\^a", r"(\(|\|)x", r"/x\\$", "é+",
]
TEXTS = ["https://example.com/docs/v2/a.html", "http://example.com/login?page=12", "https://cdn.example.net/img/a.JPG", "a b", "aab{x}", "ab||a&b]", "a\\ /edit Ω.µ", "discord.gg/a.css", "", "a(x|x -@.", "A1\t_é\x0b\x07", "a.c abc $ ^a"]


@pytest.fixture(scope="module")
def verdicts():
    """(pattern, text) -> whether it matches, or None where the pattern is refused."""
    con, out = duckdb.connect(), {}
    for p in PATTERNS:
        for t in TEXTS:
            try:
                out[p, t] = con.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0]
            except duckdb.Error:
                out[p, t] = None
    return out


@pytest.fixture(scope="module")
def patterns(spark):
    return spark.createDataFrame([(p,) for p in PATTERNS], "p string")


def test_refusals(patterns, verdicts):
    got = {r.p: r.ok for r in patterns.select("p", is_valid(F.col("p")).alias("ok")).collect()}
    assert {p: ok for p, ok in got.items() if ok != (verdicts[p, ""] is not None)} == {}


def test_matches(spark, patterns, verdicts):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    valid = patterns.filter(is_valid(F.col("p"))).withColumn("c", compiled(F.col("p"))).crossJoin(texts)
    rows = valid.select("p", "t", F.rlike("t", F.col("c.java")).alias("java"), found(F.col("t"), F.col("c")).alias("found"), "c").collect()
    assert {(r.p, r.t, r.java, r.c.java) for r in rows if r.java != verdicts[r.p, r.t]} == set()
    assert {(r.p, r.t, r.found, r.c) for r in rows if r.found != verdicts[r.p, r.t]} == set()
    assert len(rows) == sum(v is not None for v in verdicts.values())


@pytest.mark.parametrize("pattern, literal, texts", [
    (r".*/edit.*$", "/edit", {"/edit"}), (r"^https?://a\.b/.*", "://a.b/", {"http://a.b/", "https://a.b/"}), (r".*\.(jpg|png)$", ".", {".jpg", ".png"}),
    (r"/v\d+/latest(x|y\d)", "/latest", None), ("a|b", "", None), ("(?i)abc", "", None), ("ab+c{2,3}defg?h", "def", None), ("x(abcdef)?y", "x", None), ("", "", {""}),
])
def test_literals(spark, pattern, literal, texts):
    row = spark.range(1).select(longest_literal(F.lit(pattern)).alias("l"), compiled(F.lit(pattern)).alias("c")).first()
    assert row.l == literal and (set(row.c.texts) if row.c.texts is not None else None) == texts


def test_few_expressions_run(spark):
    """Of the patterns of specifications made from URLs none has to run as an expression; of others only where their literal is."""
    urls = spark.range(2000).select(F.concat(F.lit("https://h"), F.col("id") % 50, F.lit(".org/docs/"), "id", F.lit("/page.html")).alias("url"))
    specs = P.specs_from_urls(urls.limit(50)).select(any_of(F.col("follow_patterns")).alias("f"), any_of(F.col("ignore_patterns")).alias("i"))
    expressions = specs.select(F.explode(F.concat("f", "i")).alias("c")).filter("c.texts IS NULL").count()
    assert expressions == 0
    odd = urls.select("url", compiled(F.lit(r"/1\d*/page")).alias("c"))
    ran = odd.filter(runs(F.col("url"), F.col("c"))).count()
    assert ran == 2000 and odd.filter(found(F.col("url"), F.col("c"))).count() == sum(str(i).startswith("1") for i in range(2000))
    none = urls.select("url", compiled(F.lit(r"/archive/\d+")).alias("c"))
    assert none.filter(runs(F.col("url"), F.col("c"))).count() == 0
