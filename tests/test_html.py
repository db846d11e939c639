from pyspark.sql import functions as F

from corpusmill.operators import select as S, tokens as T
from corpusmill.operators.links import extract_links

PAGE = "page_id long, url string, html string"


def pages(spark, *htmls):
    return spark.createDataFrame([(i, "https://h.org/", h) for i, h in enumerate(htmls)], PAGE)


def by_page(df, column):
    return {r["page_id"]: r[column] for r in df.collect()}


def test_tokens_give_back_the_page(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    odd = pages(spark, "", "a < b <", "<p title='1>2' x=\"'>\">t</p ><!-- c", "<script>if(a<b){'</p>'}", "<?x?><!y><b")
    for df in (table, odd):
        joined = T.tokenize(df).groupBy("page_id").agg(
            F.expr("listagg(text, '') WITHIN GROUP (ORDER BY pos)").alias("all"))
        assert joined.join(df, "page_id").filter(~F.col("all").eqNullSafe(F.col("html"))).count() == 0
        assert joined.count() == df.count()


def test_token_kinds(spark):
    df = T.with_attributes(T.tokenize(pages(
        spark, "<!doctype html><P Class='a b' class=c data-x>t &amp; u<br/><script>x</p></script></P>")))
    got = [(r.kind, r.tag) for r in df.orderBy("pos").collect()]
    assert got == [("comment", None), ("open", "p"), ("text", None), ("void", "br"), ("raw", "script"), ("close", "p")]
    assert df.filter("tag = 'p' AND kind = 'open'").first().attrs == {"class": "a b", "data-x": ""}


def test_attribute_values(spark):
    from corpusmill.functions.html import attribute
    cases = [
        ('<a href="x">', "x"), ("<a HREF='x y'>", "x y"), ("<a href=/a/>", "/a/"), ("<a data-href='n' href=y>", "y"),
        ("<a title=\" href='no'\" href=yes>", "yes"), ("<a href>", ""), ("<a>", None), ("<a hrefs=q>", None),
        ('<a href="?a=1&amp;b=2">', "?a=1&b=2"), ('<a href="1" href="2">', "1"), ("<a\nhref = 'n'>", "n"),
        ("<href x>", None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, r string")
    got = [x.v for x in df.select("i", attribute(F.col("r"), "href").alias("v")).orderBy("i").collect()]
    assert got == [e for _, e in cases]


def intervals(spark, html):
    rows = T.elements(pages(spark, html)).orderBy("open_pos").collect()
    return [(r.tag, r.open_pos, r.close_pos, r.explicit_close) for r in rows]


def test_optional_end_tags(spark):
    assert intervals(spark, "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [
        ("ul", 0, 11, True), ("li", 1, 3, False), ("li", 3, 9, False), ("ul", 5, 8, True), ("li", 6, 8, False),
        ("li", 9, 11, False)]
    assert intervals(spark, "<p><b>x<br><p>y</p>") == [
        ("p", 0, 4, False), ("b", 1, 4, False), ("br", 3, 3, True), ("p", 4, 6, True)]
    assert intervals(spark, "<table><tr><td>1<td>2<tr><td>3</table>") == [
        ("table", 0, 9, True), ("tr", 1, 6, False), ("td", 2, 4, False), ("td", 4, 6, False), ("tr", 6, 9, False),
        ("td", 7, 9, False)]
    assert intervals(spark, "<dl><dt>a<dd>b<dt>c</dl>") == [
        ("dl", 0, 7, True), ("dt", 1, 3, False), ("dd", 3, 5, False), ("dt", 5, 7, False)]


def test_unclosed_and_stray_tags(spark):
    assert intervals(spark, "<main><div>a</main></div><i>x") == [
        ("main", 0, 3, True), ("div", 1, 4, True), ("i", 5, 7, False)]
    assert intervals(spark, "<main><section>a</main>b") == [("main", 0, 3, True), ("section", 1, 3, False)]
    assert intervals(spark, "</div><div>x</div>") == [("div", 1, 3, True)]


def test_intervals_nest(spark, sf):
    e = T.elements(spark.read.parquet(f"{sf}/pages.parquet"))
    a, b = e.alias("a"), e.alias("b")
    crossing = a.join(b, "page_id").filter(
        "a.open_pos < b.open_pos AND b.open_pos < a.close_pos AND a.close_pos < b.close_pos")
    assert crossing.count() == 0


def test_selectors(spark):
    html = ('<div class="a b" id=x><p data-k=v role="main">1</p><p class=c>2</p></div>'
            '<section><div><p class="c d">3</p></div></section>')
    df = pages(spark, html)

    def tags(selector):
        return [(r.tag, r.open_pos) for r in S.select(df, selector).orderBy("open_pos").collect()]

    assert tags("p") == [("p", 1), ("p", 4), ("p", 10)]
    assert tags(".b") == [("div", 0)]
    assert tags("#x") == [("div", 0)]
    assert tags("[data-k]") == [("p", 1)]
    assert tags("[role='main']") == [("p", 1)]
    assert tags("p[role='x'], p.d") == [("p", 10)]
    assert tags("section p") == [("p", 10)]
    assert tags("section div .c") == [("p", 10)]
    assert tags("div div") == []
    assert tags("#x .c, section") == [("p", 4), ("section", 8)]


def test_titles(spark):
    df = pages(
        spark,
        '<html><head></head><body><h1 class="page-title">Custom Title</h1></body></html>',
        "<html><head><title>Page Title</title></head><body></body></html>",
        "<html><head></head><body><p>No title</p></body></html>",
        "<title>T &amp; U | Big Docs</title><h1>  </h1>",
        "",
    )
    assert by_page(S.page_titles(df, ".page-title"), "title") == {
        0: "Custom Title", 1: "Page Title", 2: "Untitled", 3: "T & U", 4: "Untitled"}
    assert by_page(S.page_titles(df, None), "title")[1] == "Page Title"
    assert by_page(S.page_titles(df, "h1, title"), "title")[0] == "Custom Title"


def test_nested_title_matches_repeat_their_text(spark):
    df = pages(spark, "<div class=t><h1>A <b>B</b></h1></div>")
    assert by_page(S.page_titles(df, ".t, h1"), "title") == {0: "A BA B"}


def test_main_content(spark):
    df = pages(
        spark,
        '<main><nav>n</nav><h1>T</h1><article>in<div class="ad">AD</div>ner</article></main>',
        "<main> \n </main>",
        "<p>none</p>",
        '<div class="content">x<p class=ad>y</p>z</div><article class="ad">own</article>',
    )
    got = by_page(S.main_content(df, exclude=["nav", ".ad"]), "content")
    assert got == {0: "<h1>T</h1><article>inner</article>\n\ninner", 3: "xz\n\nown"}
    assert by_page(S.main_content(df, "main, article", ["nav", ".ad"], outermost_only=True), "content") == {
        0: "<h1>T</h1><article>inner</article>", 3: "own"}


def test_match_inside_an_excluded_element_keeps_its_own_part(spark):
    df = pages(spark, "<main>a<div class=ad>b<article>c</article></div></main>")
    assert by_page(S.main_content(df, "main, article", [".ad"]), "content") == {0: "a\n\nc"}


def test_links_after_exclusion(spark):
    html = ('<nav><a href="/n">n</a></nav><main><a href="/m">m</a><nav><a href="/x">x</a></nav>'
            '<a href="">e</a><a name=q>q</a><a class=ad href="/ad">y</a></main><a href="?z&amp;w">f</a>')
    df = pages(spark, html, '<a href="/lost">no content</a>')
    links = extract_links(df, "main", ["nav", ".ad"])
    assert sorted(r.href for r in links.collect()) == ["/m", "/n", "?z&w"]
    body = extract_links(df, "body, main", ["nav"], require_content=False)
    assert sorted(r.href for r in body.collect()) == ["/ad", "/lost", "/m", "/n", "?z&w"]
