"""Selectors as data against selectors in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import rules as R, select as S, specs as P, tokens as T
from corpusmill.plans.build import convert_sites, corpus_pages, split_specs
from tests.test_corpus import T as HOST, _spec, pages

SELECTORS = [
    "div", "*", ".a", "#x", "[href]", "[href='/u']", 'a[href="/u"], p', "div.a", "div .a", "div div", "div div div", "div p .b", ".a .a, #x", "p.a.b", "P.a", "h1, .a span",
    "[data-k=v]", "[data-k = 'v w']", "section[role=main] p", ".a .b .a .b", "", " , ", "a.b#x[href]", "[class]", "[class='a b'] *",
    "[href^='/']", "[class$=b]", "[class~=a]", "[class*=' ']", "[data-k|=v]", "[class~='a b']", "[href^='']", "div[class^=a] [data-k$='w']",
]


def _page(seed):
    x, out, open_ = random.Random(seed), [], []
    attrs = ["", " class=a", " class='a b'", " class=\"b\"", " id=x", " href=/u", " href='/u' class=a", " data-k=v", " data-k='v w'", " role=main", " class='b a' id=x href"]
    for i in range(60):
        roll = x.random()
        if roll < 0.45:
            tag = x.choice(["div", "p", "span", "a", "section", "b", "DIV", "h1", "br", "img"])
            out.append(f"<{tag}{x.choice(attrs)}>")
            if tag not in ("br", "img"):
                open_.append(tag)
        elif roll < 0.8 and open_:
            out.append(f"</{open_.pop() if x.random() < 0.9 else x.choice(open_)}>")
        else:
            out.append(f"w{i}")
    return "".join(out)


def test_same_elements(spark):
    """Every selector flags the same events either way, on pages with chains, crossings and unclosed elements."""
    rows = [(i, "https://h.org/", _page(i), s) for i, s in enumerate(s for s in SELECTORS for _ in range(4))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, selector string")
    struct = F.struct(F.lit("").alias("title"), F.col("selector").alias("content"), F.array().cast("array<string>").alias("exclude"))
    ruled = df.withColumn("rules", R.rules(struct))
    steps = df.agg(F.max(R.longest_chain(struct))).first()[0]
    stream = T.events(T.close_elements(T.tokenize(ruled, extra=(("rules",), lambda t: R.token_hits(t, F.col("rules"))))))
    data = R.flag_by_hits(stream, {R.CONTENT: "hit"}, steps).filter("hit")
    got = {}
    for r in data.select("page_id", "ord", "kind").collect():
        got.setdefault(r.page_id, set()).add((r.ord, r.kind))
    checked = 0
    for k, selector in enumerate(SELECTORS):
        own = df.filter(F.col("page_id").between(4 * k, 4 * k + 3))
        plan = S.flag_elements(T.events(T.close_elements(T.tokenize(own))), {"hit": selector}).filter("hit")
        want = {}
        for r in plan.select("page_id", "ord", "kind").collect():
            want.setdefault(r.page_id, set()).add((r.ord, r.kind))
        assert {p: e for p, e in got.items() if 4 * k <= p <= 4 * k + 3} == want, selector
        checked += sum(map(len, want.values()))
    assert steps == 4 and checked > 300


@pytest.mark.parametrize("selector, problem", [
    ("div > p", "unsupported selector: '>'"), ("a:hover", "unsupported selector: 'a:hover'"), ("[a!=b]", "unsupported selector: '[a!=b]'"), ("p, .a..b", "unsupported selector: '.a..b'"),
    ("div.a [b='c, d'], #é", None), ("", None),
])
def test_problems(spark, selector, problem):
    struct = F.struct(F.lit("h1").alias("title"), F.lit("p").alias("content"), F.array(F.lit(selector)).alias("exclude"))
    assert spark.range(1).select(R.selector_problem(struct).alias("e")).first().e == problem


def test_thousands_of_profiles(spark):
    """Each site has selectors of its own; all take one pass, whose plan does not depend on their number."""
    def converted(n):
        number = F.col("id").cast("string")
        specs = _spec(spark, {}).drop("name", "selectors", "allowed_domains", "start_urls").crossJoin(spark.range(n)).select(
            F.concat(F.lit("s"), number).alias("name"), "*",
            F.struct(F.concat(F.lit("h"), F.col("id") % 6 + 1).alias("title"), F.concat(F.lit(".c"), number).alias("content"),
                     F.array(F.concat(F.lit(".c"), number, F.lit(" .x"))).alias("exclude")).alias("selectors"),
            F.array(F.concat(F.lit("s"), number, F.lit(".example"))).alias("allowed_domains"),
            F.array(F.concat(F.lit("https://s"), number, F.lit(".example/"))).alias("start_urls"),
        ).select([f.name for f in P.SCHEMA.fields] if hasattr(P.SCHEMA, "fields") else spark.createDataFrame([], P.SCHEMA).columns)
        p = spark.range(n).select(
            F.col("id").alias("page_id"), F.concat(F.lit("https://s"), number, F.lit(".example/")).alias("url"),
            F.concat(F.lit("<h1>one</h1><h2>two</h2><p class=x>kept</p><div class=c"), number, F.lit(">text "), number, F.lit("<p class=x>gone</p></div>")).alias("html"))
        return convert_sites(p, split_specs(specs)[0])

    many, few = converted(3000), converted(2)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) < 1.05 * size(few)
    rows = many.select("site", "title", "body").collect()
    assert {(r.site, r.body) for r in rows} == {(f"s{i}", f"text {i}") for i in range(3000)}
    assert {r.title for r in rows} == {"one", "two", "Untitled"}


def test_profiles_keep_their_options(spark):
    p = pages(spark, [(HOST + "/", '<main><section>a<img src="i.png" alt="i"></section><p onclick=x>b</p></main>')]).withColumn("depth", F.lit(0))
    specs = _spec(spark, dict(name="plain", sanitize_html=True, preserve_images=False), dict(name="images", sanitize_html=True, preserve_images=True))
    got = {r.site: r.content.split("-->")[-1].strip() for r in corpus_pages(p, specs).collect()}
    assert got == {"plain": "a\n\nb", "images": "a![i](i.png)\n\nb"}
