import glob

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import urls as U
from corpusmill.operators import corpus as C, document as D, links as L, specs as P
from corpusmill.operators.crawl import crawl_depths
from corpusmill.plans.build import build_corpus, convert_sites, corpus_pages, publish, split_specs
from corpusmill.sources.pages import scan_html_files, write_corpus
from corpusmill.streaming import ingest

T = "https://t.example"


def spec_row(**changes):
    row = dict(
        name="Test", base_url="https://example.com", output_file="output.md", start_urls=["https://example.com/docs"],
        follow_patterns=[], ignore_patterns=[], selectors=("h1", "", []), max_depth=1, concurrency=1, delay=0.0,
        generate_toc=True, sanitize_html=True, include_metadata=True, preserve_images=False, max_file_size="10MB",
        allowed_domains=[])
    return tuple((row | changes).values())


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame(
        [("fern", "green", 0), ("moss", "green", 0), ("rose", "red", 1)], "url string, content string, depth int")
    assert sorted(r.url for r in C.dedup_content(df, key="url").collect()) == ["fern", "rose"]
    group = C.duplicate_groups(df).first()
    assert (group.n, group.kept_url) == (2, "fern")


def test_order_over_many_partitions(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("hot").alias("site"), (F.col("id") % 5).cast("int").alias("depth"),
        F.concat(F.lit("u"), F.hash("id").cast("string"), F.lit("-"), "id").alias("url"))
    got = C.order_pages(df.repartition(7)).collect()
    for site in ("a", "hot"):
        rows = sorted((r for r in got if r.site == site), key=lambda r: (r.depth, r.url.encode()))
        assert [r.ord for r in rows] == list(range(1, len(rows) + 1))
    tenth = C.milestones(C.order_pages(df)).count()
    assert tenth == 1667 // 10 + 3333 // 10


def test_crawl_depths(spark):
    edges = spark.createDataFrame([tuple(e) for e in ("ab", "bc", "cd", "ac", "da", "cx")], "src string, dst string")
    known = spark.createDataFrame([(u,) for u in "abcd"], "url string")
    starts = spark.createDataFrame([("a",), ("q",)], "url string")
    assert dict(crawl_depths(known, edges, starts, 3).collect()) == {"a": 1, "b": 2, "c": 2, "d": 3}
    assert dict(crawl_depths(known, edges, starts, 2).collect()) == {"a": 1, "b": 2, "c": 2}
    assert [r.url for r in L.missing_pages(edges, known).collect()] == ["x"]


def test_dedup_urls_and_skip_report(spark):
    df = spark.createDataFrame(
        [(1, "https://a.org/x", True), (2, "https://a.org/x", True), (3, "https://a.org/X", False), (4, "https://b.org/", True)],
        "page_id long, url string, has_content boolean")
    assert sorted(r.page_id for r in L.dedup_urls(df).collect()) == [1, 3, 4]
    got = {(r.url, r.reason): r.pages for r in L.skip_report(df, ["a.org"]).collect()}
    assert got == {("https://a.org/x", "already_visited"): 1, ("https://a.org/X", "no_content_found"): 1,
                   ("https://b.org/", "disallowed_domain"): 1}


def test_assign_site(spark):
    specs = spark.createDataFrame(
        [spec_row(name="all"), spec_row(name="x", allowed_domains=["x.org", "docs.x.org"])], P.SCHEMA)
    p = pages(spark, [("https://a.docs.x.org/1", ""), ("https://badx.org/", ""), ("nohost", "")]).drop("html")
    got = sorted((r.page_id, r.site) for r in L.assign_site(p, specs).collect())
    assert got == [(0, "all"), (0, "x"), (1, "all"), (2, "all")]


SITE_B = [
    (T + "/", '<main><p>Harbour of the site</p></main><a href="/boats">1</a><a href="/nets">2</a>'
              '<a href="https://elsewhere.example/sea">e</a><a href="/privacy">p</a>'),
    (T + "/boats", "<main><h1>Pier</h1><p>Wood and tar</p></main>"),
    (T + "/nets", "<main><h1>Pier</h1><p>Wood and tar</p></main>"),
    (T + "/privacy", "<main>legal</main>"),
    (T + "/unlinked", "<main>never reached</main>"),
]


def test_site_from_links_to_document(spark):
    specs = spark.createDataFrame([spec_row(name="B", base_url=T, start_urls=[T + "/"], max_depth=2)], P.SCHEMA)
    got = {r.url: (r.ord, r.depth) for r in corpus_pages(pages(spark, SITE_B), specs).collect()}
    assert got == {T + "/": (1, 1), T + "/boats": (2, 2), T + "/nets": (3, 2)}
    deduplicated = corpus_pages(pages(spark, SITE_B), specs, dedup_on="body")
    assert sorted(r.url for r in deduplicated.collect()) == [T + "/", T + "/boats"]


def test_document_and_sink(spark, tmp_path):
    rows = [("https://example.com/", "Home", "# Home\nThe gate is open", 0, 1),
            ("https://example.com/api", "Untitled", "# Calls\nEvery call in turn\n", 1, 2),
            ("https://example.com/x", "X (y)", " \n", 7, 3)]
    ordered = spark.createDataFrame(
        [("Doc", *r) for r in rows], "site string, url string, title string, content string, depth int, ord long")
    specs = spark.createDataFrame([spec_row(name="Doc", max_depth=2)], P.SCHEMA)
    expected = (
        "# Doc\n\n*Generated on 2025-01-02 03:04:05*\n\n- **Base URL**: https://example.com\n- **Total Pages**: 3\n"
        "- **Max Depth**: 2\n\n---\n\n## Table of Contents\n\n- [Home](#home)\n  - [Untitled](#untitled)\n"
        + "  " * 7 + "- [X (y)](#x-y)\n\n---\n\n"
        "# Home\n\n*Source: [https://example.com/](https://example.com/)*\n\n# Home\nThe gate is open\n\n\n---\n\n"
        "## Api\n\n*Source: [https://example.com/api](https://example.com/api)*\n\n# Calls\nEvery call in turn\n\n\n---\n\n"
        "###### X (y)\n\n*Source: [https://example.com/x](https://example.com/x)*\n\n")
    parts = D.assemble(ordered, specs, "2025-01-02 03:04:05")
    chunks = parts.orderBy("part", "chunk").collect()
    assert "".join(r.markdown for r in chunks) == expected
    write_corpus(parts, str(tmp_path / "out"))
    files = sorted(glob.glob(str(tmp_path / "out" / "site=Doc" / "part-*.txt")))
    assert "".join(open(f, encoding="utf-8").read() for f in files) == expected


def test_document_without_metadata_and_contents(spark):
    ordered = spark.createDataFrame([("S", "u/a-b", "", "t", 0, 1)],
                                    "site string, url string, title string, content string, depth int, ord long")
    specs = spark.createDataFrame([spec_row(name="S", generate_toc=False, include_metadata=False)], P.SCHEMA)
    assert [r.markdown for r in D.assemble(ordered, specs, "2025-01-01 00:00:00").orderBy("part").collect()] == ["# A B\n\nt\n"]


def test_spec_defaults(spark):
    empty = spark.createDataFrame([spec_row(max_depth=0, concurrency=0, delay=0.0, selectors=("", "", None),
                                            max_file_size="5MB"), spec_row(max_file_size="invalid-size")], P.SCHEMA)
    a, b = P.with_defaults(empty).collect()
    assert (a.max_depth, a.concurrency, a.delay, a.selectors.title, a.selectors.content, a.max_file_size_bytes) == (
        5, 3, 1.0, "h1", "main, article, .content", 5242880)
    assert b.max_file_size_bytes is None


@pytest.mark.parametrize("changes, error", [
    (dict(max_depth=5, concurrency=3), None),
    (dict(name=""), "name is required"),
    (dict(base_url="not-a-url"), "base_url must include scheme"),
    (dict(start_urls=["not-a-url"]), "start_urls[0] must include scheme"),
    (dict(start_urls=[]), "start_urls is required"),
    (dict(follow_patterns=["[invalid regex"]), "invalid follow_pattern[0]"),
    (dict(ignore_patterns=["ok", "a(?!b)"]), "invalid ignore_pattern[1]"),
    (dict(allowed_domains=["invalid-domain"]), "invalid domain format"),
    (dict(max_depth=0), "max_depth must be greater than 0, got 0"),
    (dict(delay=-1.0), "delay must be non-negative"),
    (dict(concurrency=0), "concurrency must be greater than 0"),
    (dict(allowed_domains=[""]), "allowed_domains[0] cannot be empty"),
])
def test_spec_errors(spark, changes, error):
    got = P.spec_errors(spark.createDataFrame([spec_row(**changes)], P.SCHEMA)).first().error
    assert got is None if error is None else error in got


def test_specs_from_urls(spark):
    urls = spark.createDataFrame([(u,) for u in ("https://example.com/docs", "not-a-valid-url", "http://example.com/docs")],
                                 "url string")
    a, b, c = P.specs_from_urls(urls).collect()
    assert (a.name, a.base_url, a.output_file) == (
        "Example.com Documentation", "https://example.com", "example-com-docs.md")
    assert len(a.follow_patterns) == 11 and len(a.ignore_patterns) == 32 and c.base_url == "http://example.com"
    errors = [r.error for r in P.spec_errors(P.specs_from_urls(urls)).collect()]
    assert errors[0] is None and "domain format" in errors[1] and errors[2] is None
    assert P.specs_from_urls(urls).columns == [f.name for f in spark.createDataFrame([], P.SCHEMA).schema]


def test_site_status(spark):
    starts = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("d", "5")], "site string, url string")
    fetched = spark.createDataFrame([("a", "1"), ("c", "4"), ("d", "5")], "site string, url string")
    kept = spark.createDataFrame([("a", "1"), ("c", "4")], "site string, url string")
    got = {r.site: r.status for r in C.site_status(starts, fetched, kept).collect()}
    assert got == {"a": "partial", "b": "all start URLs failed", "c": "ok", "d": "no pages to aggregate"}


def test_html_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "i.html").write_text("<p>\nx</p>")
    row = scan_html_files(spark, str(tmp_path), str(tmp_path), "https://h.org/").first()
    assert (row.url, row.html) == ("https://h.org/d/i.html", "<p>\nx</p>")


def test_streams_equal_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"u{i % 5}", f"text {i % 4}") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in range(3):
        df.filter(F.col("page_id") % 3 == part).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: ingest.page_source(spark, src, max_files=1)
    ingest.stream_pages(stream(), lambda b: b, out, dedup_on="html").awaitTermination()
    ingest.stream_first_copies(spark, out).awaitTermination()
    assert sorted(r.html for r in spark.read.parquet(f"{out}/distinct").collect()) == [f"text {i}" for i in range(4)]
    ingest.stream_distinct_hashes(stream(), "html", f"{out}/h").awaitTermination()
    assert spark.read.parquet(f"{out}/h/hashes").distinct().count() == 4
    ingest.stream_counts(stream(), "url", f"{out}/c").awaitTermination()
    assert dict(ingest.latest_counts(spark, f"{out}/c").collect()) == {"u0": 3, "u1": 3, "u2": 2, "u3": 2, "u4": 2}


def test_quick_mode_selectors_run(spark):
    spec = P.specs_from_urls(spark.createDataFrame([("https://t.example/docs",)], "url string"))
    p = pages(spark, [("https://t.example/docs", "<body><nav><a href=/n>n</a></nav><main><h1>T</h1><p class=ad>x</p>b</main></body>")])
    doc = build_corpus(p.withColumn("depth", F.lit(0)), spec, "2025-01-01 00:00:00")
    text = "".join(r.markdown for r in doc.orderBy("part", "chunk").collect())
    # main and body both match, so the text stands twice
    assert text.count("# T\n\nb") == 2
    assert "\nx" not in text and "[n]" not in text


def _spec(spark, *changes):
    return spark.createDataFrame([spec_row(base_url=T, start_urls=[T + "/"], allowed_domains=["t.example"], **c) for c in changes], P.SCHEMA)


def test_equal_urls_are_one_page(spark):
    rows = [(T + "/a", "<main>one</main>"), (T + "/a", "<main>later copy</main>"), (T + "/b", "<main>two</main>")]
    got = corpus_pages(pages(spark, rows).withColumn("depth", F.lit(0)), _spec(spark, {}))
    assert sorted((r.ord, r.url) for r in got.collect()) == [(1, T + "/a"), (2, T + "/b")]


def test_given_depths_are_limited(spark):
    p = pages(spark, [(T + "/a", "<main>x</main>"), (T + "/b", "<main>y</main>")]).withColumn("depth", (F.col("page_id") * 9).cast("int"))
    assert [r.url for r in corpus_pages(p, _spec(spark, dict(max_depth=2))).collect()] == [T + "/a"]


def test_equal_names_are_one_site(spark):
    specs = spark.createDataFrame(
        [spec_row(base_url=T, start_urls=[T + u], allowed_domains=["t.example"]) for u in ("/", "/b")], P.SCHEMA)
    p = pages(spark, [(T + "/", "<main>x</main>"), (T + "/b", "<main>y</main>")])
    assert sorted(r.url for r in corpus_pages(p, specs).collect()) == [T + "/", T + "/b"]
    assert build_corpus(p, specs, "2025-01-01 00:00:00").filter("part = 0").count() == 1


def test_a_bad_specification_stops_only_itself(spark, tmp_path):
    specs = _spec(spark, dict(name="good", output_file="good.md"), dict(name="bad", max_depth=-1), dict(name="odd", selectors=("h1", "a > b", [])),
                  dict(name="lost", output_file="lost.md", max_depth=3))
    specs = specs.withColumn("start_urls", F.when(F.col("name") == "lost", F.array(F.lit(T + "/none"))).otherwise(F.col("start_urls")))
    p = pages(spark, [(T + "/", "<main><p>here</p></main>")])
    valid, rejected = split_specs(specs)
    assert sorted(r.name for r in valid.collect()) == ["good", "lost"]
    publish(p, specs, str(tmp_path / "out"), "2025-01-01 00:00:00")
    assert {r.name: r.error for r in spark.read.parquet(str(tmp_path / "out/_rejected")).collect()}.keys() == {"bad", "odd"}
    assert {r.site: r.status for r in spark.read.parquet(str(tmp_path / "out/_status")).collect()} == {"good": "ok", "lost": "all start URLs failed"}
    assert glob.glob(str(tmp_path / "out/documents/output_file=good.md/part-*.txt"))
    assert not glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/store-*")


def test_many_profiles_in_one_pass(spark):
    changes = [dict(name=f"s{i}", selectors=(f"h{i % 6 + 1}", f".c{i}", [".x"] if i % 2 else []), sanitize_html=bool(i % 3)) for i in range(60)]
    p = pages(spark, [(T + f"/{i}", f'<div class="c{i}">text {i}<p class=x>gone</p></div>') for i in range(3)])
    valid, _ = split_specs(_spec(spark, *changes))
    converted = convert_sites(p, valid)
    got = {(r.site, r.page_id): r.body for r in converted.collect()}
    assert got == {("s0", 0): "text 0\n\ngone", ("s1", 1): "text 1", ("s2", 2): "text 2\n\ngone"}
    plan = converted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("html#") and plan.count("regexp_extract_all(html#") == 1


def test_links_are_resolved_once(spark):
    links = spark.createDataFrame([(T + "/d/", "e"), (T + "/", "#top")], "url string, href string")
    edges = L.follow_edges(links, [f"/p{i}" for i in range(20)] + ["/d/e"], [f"/q{i}" for i in range(30)], ["t.example"])
    assert [tuple(r) for r in edges.collect()] == [(T + "/d/", T + "/d/e")]
    one = links.select(F.explode(F.array_compact(F.array(U.resolve_url(F.col("url"), F.col("href"))))))
    resolutions = [df._jdf.queryExecution().optimizedPlan().toString().count(r"(\?[^#]*)") for df in (edges, one)]
    assert resolutions[0] == resolutions[1] > 0


@pytest.mark.parametrize("pattern, ok", [
    (r"(?P<n>x)", True), (r"a\\1", True), (r"[[:alpha:]]+", True), (r"[*+]+", True), (r"\++", True), (r"a++", False), (r"(?>a)", False), (r"(a)\1", False),
    (r"(?<!a)b", False), (r"a\Z", False),
])
def test_pattern_dialect(spark, pattern, ok):
    got = P.spec_errors(spark.createDataFrame([spec_row(follow_patterns=[pattern])], P.SCHEMA)).first().error
    assert (got is None) == ok, got


def test_base_href(spark):
    html = '<base href="https://t.example/d/"><base href="/x/"><main>m <a href="e">1</a></main><a href="/r">2</a>'
    links = L.extract_links(pages(spark, [(T + "/p/q", html), (T + "/p/r", html.replace("<base", "<bose"))]), "main")
    got = {(r.src, r.dst) for r in L.follow_edges(links).collect()}
    assert got == {(T + "/p/q", T + "/d/e"), (T + "/p/q", T + "/r"), (T + "/p/r", T + "/p/e"), (T + "/p/r", T + "/r")}
    specs = _spec(spark, dict(max_depth=2))
    crawl = pages(spark, [(T + "/", '<base href="/d/"><main><a href="e">1</a></main>'), (T + "/d/e", "<main>e</main>"), (T + "/e", "<main>no</main>")])
    assert {r.url for r in corpus_pages(crawl, specs).collect()} == {T + "/", T + "/d/e"}
