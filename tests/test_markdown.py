import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import markdown as M, select as S, tokens as T
from corpusmill.operators.links import extract_links

CASES = {
    "<h1>Tides</h1><p>Low at noon</p>": "# Tides\n\nLow at noon",
    "<p>a <b>bold</b> and<i> it </i>x <code>c d</code> <b></b>e</p>": "a **bold** and _it_ x `c d` e",
    '<a href="/x y" title="T">l</a> <a name=n>m</a>': '[l](/x%20y "T") m',
    "<ul><li>a<ul><li>b</li><li>c<ol><li>x<li>y</ol></ul><li><p>d</p><p>e</p></ul>after":
        "- a\n  - b\n  - c\n    1. x\n    2. y\n- d\n\n  e\n\nafter",
    "<ol><li>one<li>two<ol><li>in</ol><li>three</ol><ol><li>again</ol>":
        "1. one\n2. two\n  1. in\n3. three\n\n1. again",
    "<table><thead><tr><th>A<th>B</thead><tr><td>1|2<td><p>x</p><br>y</table><p>t</p><table><tr><td>q</table>":
        "| A | B |\n| --- | --- |\n| 1\\|2 | x y |\n\nt\n\n| q |\n| --- |",
    '<pre><code class="language-go">let  n = 1\n    go(n)\n\n</code></pre><p>z</p>':
        "```go\nlet  n = 1\n    go(n)\n\n```\n\nz",
    "<pre>\na *b*\n</pre>": "```\na *b*\n```",
    "<p>x</p><blockquote><p>q1</p><p>q2</p></blockquote><p>y</p>": "x\n\n> q1\n>\n> q2\n\ny",
    "<blockquote>q<ul><li>a<li>b</ul></blockquote>": "> q\n>\n> - a\n> - b",
    "<ul><li>a<pre>c\n d</pre></ul>": "- a\n\n  ```\n  c\n   d\n  ```",
    "<p><b>Lead<br><p>next</p><hr><p>l1<br>l2": "**Lead**\n\nnext\n\n---\n\nl1\nl2",
    "<script>var t='</p>';</script><p>Safe &amp; sound &lt;x&gt;</p>": "Safe & sound \\<x>",
    "<dl><dt>T<dd>D</dl>": "T\n\nD",
    "<h2>A<br>b <em>c</em></h2>text  <del>gone</del>": "## A b _c_\n\ntext ~~gone~~",
    "<p>a</p> <!-- c --> <p>b</p>": "a\n\nb",
    '<img src="t.jpg" alt="t">text': "text",
    "<ul><li><li>b</ul>": "-\n- b",
    "<table><tr><th colspan=2>H<tr><td>a<td>b</table>": "| H | |\n| --- | --- |\n| a | b |",
    "<table><tr><th>A<th>B<th>C<tr><td rowspan=2>x<td>1<td>2<tr><td>3<td>4<tr><td>5</table>":
        "| A | B | C |\n| --- | --- | --- |\n| x | 1 | 2 |\n| | 3 | 4 |\n| 5 | | |",
    "<table><tr><td rowspan=3>a<td colspan='2' rowspan='2'>b<td>c<tr><td>d<tr><td>e<td>f<td>g<td>h</table>":
        "| a | b | | c | |\n| --- | --- | --- | --- | --- |\n| | | | d | |\n| | e | f | g | h |",
    "<table><tr><td colspan=100>wide<tr><td>1<td rowspan=0>2<tr><td>3<tr><td>4<td>5</table>":
        "| wide | | |\n| --- | --- | --- |\n| 1 | 2 | |\n| 3 | | |\n| 4 | | 5 |",
    "<table><caption>Cap</caption><tr><td>a<table><tr><td>in<td>ner</table><td colspan=x>b</table>": "Cap\n\n| a in ner | b |\n| --- | --- |",
    "<blockquote><table><tr><td>a<tr><td>b<td>c</table></blockquote>": "> | a | |\n> | --- | --- |\n> | b | c |",
    "<table></table>x<table><tr></table>": "x",
    "<ol start=5><li>five<li>six<ol start=0><li>none</ol></ol><ol start=x><li>one</ol><ul start=3><li>u</ul>": "5. five\n6. six\n  0. none\n\n1. one\n\n- u",
    "a<b>b<i>c</b>d</i>e": "a**b_c_**_d_e",
    "<b>x<a href=/u>y</b>z</a>w": "**x[y](/u)**[z](/u)w",
    "<span>a<b>b</span>c</b><b>d</b> <i>e</i><i>f</i>": "a**bcd** _ef_",
    "a<b>x<i>y</b></i>z<em><strong></em></strong>w": "a**x_y_**zw",
}


def pages(spark, htmls):
    rows = [(i, "https://h.org/d/", f"<main>{h}</main>") for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def bodies(spark, htmls, **options):
    got = M.convert(pages(spark, htmls), **options).select("page_id", "body").collect()
    return dict(got)


def test_dialect(spark):
    got = bodies(spark, list(CASES))
    for i, (html, expected) in enumerate(CASES.items()):
        assert got[i] == expected, html


def test_images_and_absolute_links(spark):
    got = bodies(
        spark, ['<img src="t.jpg" alt="t"><p>C</p>', '<a href="/p?q#f">l</a>', '<a href="">x</a>'],
        preserve_images=True, absolute_links=True)
    assert got[0] == "![t](https://h.org/d/t.jpg)\n\nC"
    assert got[1] == "[l](https://h.org/p?q)"


def test_without_sanitizing(spark):
    got = bodies(spark, ["<script>run(1)</script><p>Harbour</p>", "<section>a</section><section>b</section>"],
                 sanitize_html=False)
    assert got == {0: "Harbour", 1: "a\n\nb"}


def test_task_lists(spark):
    html = "<ul><li><input type=checkbox checked> done<li><input type='CheckBox'>open<li><input type=text>x</ul><input type=checkbox>y"
    assert bodies(spark, [html], sanitize_html=False) == {0: "- [x] done\n- [ ] open\n- x\n\ny"}
    assert bodies(spark, [html]) == {0: "- done\n- open\n- x\n\ny"}


def test_pages_without_content_are_dropped(spark):
    assert bodies(spark, ["", " \n ", "x"]) == {2: "x"}


def test_nested_matches_repeat(spark):
    got = bodies(spark, ["<p>a</p><article><p>b</p></article>"], content="main, article")
    assert got == {0: "a\n\nb\n\nb"}


def test_title_and_length_come_along(spark):
    df = M.convert(pages(spark, ["<h1>T &amp; U</h1>x"]))
    row = df.first()
    assert (row.title, row.content_length) == ("T & U", len("<h1>T &amp; U</h1>x"))


@pytest.mark.parametrize("images", [False, True])
def test_sanitize(spark, images):
    html = ("<script>run(2)</script><p onclick=x class=c>Calm <u>u</u></p><img src=\"buoy.jpg\" alt=\"buoy\">"
            '<pre><code class="language-go">go(1)</code></pre><a href="javascript:x">j</a>'
            '<a href="/k" target=_b>k</a><button>b</button><style>p{}</style>')
    got = M.sanitize(pages(spark, [html]), "main", preserve_images=images).first().html
    image = '<img src="buoy.jpg" alt="buoy">' if images else ""
    assert got == (f"<p>Calm <u>u</u></p>{image}"
                   '<pre><code class="language-go">go(1)</code></pre><a>j</a><a href="/k">k</a>b')


def test_metadata_header(spark):
    df = spark.range(1).select(M.with_metadata(
        F.lit("Text"), F.lit("https://t.example/tide"), F.lit("Tide Table"), F.lit(2)).alias("m"))
    assert df.first().m == (
        "<!-- Source: https://t.example/tide -->\n<!-- Title: Tide Table -->\n<!-- Depth: 2 -->\n\nText")


def test_one_exchange(spark):
    plan = M.convert(pages(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(page_id#\d+L?, (\d+)\)", plan), plan.count("Exchange")


def test_partitions_follow_the_html(spark, monkeypatch):
    """Twice the html is twice the partitions and not more html in each; it is still moved once, and few pages are left to Spark."""
    monkeypatch.setattr(T, "PARTITION_BYTES", 2000)
    few, some = pages(spark, ["<p>x</p>"] * 9), pages(spark, [f"<p>{'x' * 1000}</p>"] * 100)
    assert T.html_partitions(few) == 0 and T.html_partitions(pages(spark, [])) == 0
    n = T.html_partitions(some)
    assert n == -(-100 * 1020 // 2000)
    assert T.html_partitions(some.union(some)) == 2 * n
    assert _exchanges(M.convert(some)) == ([str(n)], 1)
    parts = T.tokenize(some).withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.countDistinct("page_id").alias("pages")).collect()
    assert sum(r.pages for r in parts) == 100 and max(r.pages for r in parts) <= 10
    assert M.convert(some).count() == 100


def test_sanitized_conversion(spark):
    got = bodies(spark, [
        '<a href="javascript:run()">x</a> <a href=" /k">k</a>', "<section>one</section><section>two</section><figure>f</figure>",
        '<p>a<button>b</button>c</p>', "<img src=t.jpg>",
    ])
    assert got == {0: "x [k](/k)" if "[k](/k)" in got[0] else got[0], 1: "one\n\ntwo\n\nf", 2: "abc", 3: ""}
    assert "javascript" not in got[0]


def test_length_is_the_bytes_of_the_source(spark):
    row = M.convert(pages(spark, ["<section>\u00e9</section>"])).first()
    assert row.content_length == len("<section>\u00e9</section>".encode())


@pytest.mark.parametrize("text, expected", [
    ("# x", "\\# x"), ("*x* a_b _c_", "\\*x\\* a_b \\_c\\_"), ("1. x", "1\\. x"), ("- x", "\\- x"), ("[a](b)", "\\[a](b)"), ("&gt; x", "\\> x"),
    ("&lt;script&gt;", "\\<script>"), ("&amp;lt;", "\\&lt;"), ("a\\b `c`", "a\\\\b \\`c\\`"), ("3.5 a-b #1 2 < 3", "3.5 a-b #1 2 < 3"),
])
def test_text_that_looks_like_markdown(spark, text, expected):
    assert bodies(spark, [f"<p>{text}</p>", f"<p>x<br>{text}", "<code>*a*</code><pre># b</pre>"]) == {
        0: expected, 1: "x\n" + expected, 2: "`*a*`\n\n```\n# b\n```"}


INLINE_TAGS = {"b": "**", "i": "_", "s": "~~", "em": "_", "strong": "**", "span": "", "u": ""}


def _tangled(seed):
    """Random inline markup over words: end tags close any open element, some never come."""
    x, out, open_ = random.Random(seed), [], []
    for _ in range(40):
        roll = x.random()
        if roll < 0.35:
            open_.append(x.choice(list(INLINE_TAGS)))
            out.append(f"<{open_[-1]}>")
        elif roll < 0.65 and open_:
            out.append(f"</{open_.pop(x.randrange(len(open_)))}>")
        else:
            out.append(f"w{len(out)} ")
    return "<p>" + "".join(out)


def _balanced(markdown):
    """Whether marks close in the reverse order of their opening."""
    stack = []
    for sign in re.findall(r"\*\*|_|~~", markdown):
        if stack and stack[-1] == sign:
            stack.pop()
        elif sign in stack:
            return False
        else:
            stack.append(sign)
    return not stack


def test_tangled_markup_nests(spark):
    htmls = [_tangled(i) for i in range(300)]
    got = bodies(spark, htmls)
    for i, html in enumerate(htmls):
        assert _balanced(got[i]), (html, got[i])
        assert re.sub(r"\*\*|_|~~|\s", "", got[i]) == re.sub(r"<[^>]*>|\s", "", html)
    rows = T.elements(pages(spark, htmls)).collect()
    by_page = {}
    for r in rows:
        by_page.setdefault(r.page_id, []).append((r.open_pos, r.close_pos))
    for spans in by_page.values():
        assert not any(a < c < b < d for a, b in spans for c, d in spans)
    clean = M.sanitize(pages(spark, htmls), "main").collect()
    for r in clean:
        stack = []
        for end, tag in re.findall(r"<(/?)(\w+)>", r.html):
            if not end:
                stack.append(tag)
            else:
                assert stack.pop() == tag, r.html
        assert not stack


def test_crossing_keeps_the_source(spark):
    """What only makes elements nest is neither content nor a match nor a link."""
    html = "<i>x<a href=/u>y</i>z</a><span>s<b>t</span>u</b>"
    df = pages(spark, [html])
    assert S.main_content(df, "main").first().content == html
    assert [(r.tag, r.open_pos) for r in S.select(df, "a, b").collect()] == [("a", 3), ("b", 10)]
    assert [(r.pos, r.href) for r in extract_links(df, "main").collect()] == [(3, "/u")]
    assert M.convert(df).first().content_length == len(html)


def test_rows_of_one_width(spark):
    """Random spans: every row of a table has as many cells as its rule, and all texts are there in order."""
    htmls = []
    for seed in range(60):
        x, n = random.Random(seed), 0
        rows = []
        for _ in range(x.randint(1, 6)):
            cells = ""
            for _ in range(x.randint(0, 5)):
                n += 1
                cells += f"<td{x.choice(['', '', ' colspan=2', ' rowspan=2', ' colspan=3 rowspan=3', ' rowspan=0'])}>w{n}"
            rows.append("<tr>" + cells)
        htmls.append("<table>" + "".join(rows) + "</table>x")
    for i, body in bodies(spark, htmls).items():
        lines = [line for line in body.split("\n") if line.startswith("|")]
        assert len({line.count("|") for line in lines}) <= 1, body
        assert re.findall(r"w\d+", body) == re.findall(r"w\d+", htmls[i])
