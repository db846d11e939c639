"""Streams over several batches against what a batch job makes of all rows."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import corpus as C
from corpusmill.plans import registry
from corpusmill.plans.build import build_corpus, corpus_pages
from corpusmill.streaming import ingest
from corpusmill.streaming.documents import stream_documents
from tests.test_corpus import _spec

PAGES = "page_id long, url string, html string"


def _source(spark, path):
    return ingest.page_source(spark, path, max_files=1)


def _arrive(spark, path, rows):
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_one_file_and_of_many(spark, tmp_path, files):
    """A table is a file in small sets and a folder of files in large ones; streams read all of either, and nothing beside it."""
    sf = str(tmp_path / "sf")
    os.makedirs(sf)

    def table(name, rows, schema):
        at = str(tmp_path / f"made-{name}")
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(at)
        if files == 1:
            os.link(glob.glob(f"{at}/part-*")[0], f"{sf}/{name}.parquet")
        else:
            os.symlink(at, f"{sf}/{name}.parquet")

    table("pages", [(i, f"https://h.org/{i}", f"<article><p>text {i % 4}</p></article>") for i in range(40)], PAGES)
    documents = [(i, f"text {i % 30}", "en", "web", 7) for i in range(60)]
    table("documents", documents, "doc_id long, text string, lang string, source string, n_chars long")
    table("documents.parquet.old", [(0, "beside it", "en", "web", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert registry.QUERIES["stream_content_dedup"](spark, sf).count() == 30
    got = registry.QUERIES["stream_pages"](spark, sf).collect()
    assert sorted(r.body for r in got) == [f"text {i}" for i in range(4)]
    assert ingest.page_source(spark, sf, "pages.parquet").isStreaming


def test_batches_of_several_files(spark, tmp_path):
    """A batch is as many files as tasks read it, none holds all of it, and a stream still takes one batch at a time, also empty ones."""
    out, size = str(tmp_path / "in"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = spark.range(0, 20000, 1, 4).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    number = F.when(F.col("id") < 100, 0).when(F.col("id") < 15000, 1).otherwise(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        files = registry.in_batches(df, number, 4, out)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert files > 1 and len(glob.glob(f"{out}/part-*")) == 4 * files
    counts = spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in counts) == 20000 and max(r["count"] for r in counts) < 10000
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(out)
    seen = {}
    query = stream.writeStream.foreachBatch(lambda rows, k: seen.update({k: {r.n for r in rows.select(number.alias("n")).distinct().collect()}})).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == {0: {0}, 1: {1}, 2: set(), 3: {3}}


def test_recent_hashes_shrink(spark, tmp_path):
    """A content is forgotten once the clock has passed the horizon after it; the state only holds recent ones."""
    rows = [(d, f"text {d} {i}") for d in range(12) for i in range(20)] + [(d, "daily") for d in range(12)]
    df = spark.createDataFrame(rows, "day long, text string").withColumn("at", F.timestamp_add("DAY", F.col("day").cast("int"), F.lit("2025-01-01").cast("timestamp")))
    for d in range(12):
        df.filter(F.col("day") == d).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("day long, text string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.stream_recent_hashes(stream, "text", str(tmp_path / "out"), "at", "2 days", keep=("day", "text"))
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert max(state) <= 6 * 20 + 2 and state[-1] < 200 < 12 * 20
    got = spark.read.parquet(str(tmp_path / "out/hashes"))
    assert sorted(r.day for r in got.filter("text = 'daily'").collect()) == [0, 6]
    assert got.filter("text <> 'daily'").count() == 240


def test_file_time(spark, tmp_path):
    _arrive(spark, str(tmp_path / "in"), [(1, "u", "a"), (2, "v", "a")])
    stream = ingest.with_file_time(_source(spark, str(tmp_path / "in")))
    ingest.stream_recent_hashes(stream, "html", str(tmp_path / "out"), "arrived", "1 hour").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/hashes")).count() == 1


def test_count_log(spark, tmp_path):
    """Batches write what they touch; totals and latest counts are right before and after the log is folded."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _arrive(spark, src, [(i, f"u{i}", "") for i in range(500)])
    want = {f"u{i}": 1 for i in range(500)}
    sizes = []
    for batch in range(1, 7):
        ingest.stream_counts(_source(spark, src).select("url"), "url", out, compact_every=3).awaitTermination()
        assert dict(ingest.latest_counts(spark, out).collect()) == want
        sizes.append(sum(spark.read.parquet(f).count() for f in glob.glob(f"{out}/changes/batch={batch - 1}")))
        assert len(glob.glob(f"{out}/changes/*")) <= 2 and len(glob.glob(f"{out}/totals/*")) <= 1
        _arrive(spark, src, [(0, f"u{batch}", ""), (1, "u0", "")])
        want[f"u{batch}"] += 1
        want["u0"] += 1
    assert sizes == [500, 2, 0, 2, 2, 0]  # folded batches are gone


def test_milestones_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i % 3, f"u{(i * 37) % 100:03}") for i in range(95)]
    df = spark.createDataFrame(rows, "depth int, url string")
    for depth in range(3):
        df.filter(F.col("depth") == depth).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ingest.stream_progress(stream, out).awaitTermination()
    want = C.milestones(C.order_pages(df.withColumn("site", F.lit("s")))).select("depth", "url", "ord").collect()
    got = spark.read.parquet(f"{out}/milestones").select("depth", "url", "ord").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 9
    progress = spark.read.parquet(f"{out}/progress")
    assert sorted((r.batch, r.pages) for r in progress.collect()) == [(0, 32), (1, 32), (2, 31)]


def test_documents_follow_the_stream(spark, tmp_path):
    """After each batch the documents are those of a full build; files of other sites stay as they are."""
    src, out, at = str(tmp_path / "in"), str(tmp_path / "out"), "2025-01-01 00:00:00"
    specs = _spec(spark, dict(name="a", max_depth=9), dict(name="b", max_depth=9)).withColumns({
        "allowed_domains": F.array(F.concat("name", F.lit(".example"))), "start_urls": F.array(F.concat(F.lit("https://"), "name", F.lit(".example/")))})
    page = lambda k, site, path, *to: (k, f"https://{site}.example/{path}", f"<main><p>{site} {path}</p>" + "".join(f'<a href="/{t}">{t}</a>' for t in to) + "</main>")
    batches = [
        [page(1, "a", "", "x", "y"), page(2, "a", "x"), page(3, "b", "", "p"), page(4, "b", "q")],
        [page(5, "a", "y", "z"), page(6, "a", "z")],
        [page(0, "b", "", "p", "q"), page(7, "b", "p"), page(9, "b", "q", "late copy of a URL")],
    ]
    rows = []
    for batch in batches:
        _arrive(spark, src, batch)
        rows += batch
        before = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/documents/**/part-*", recursive=True)}
        stream_documents(_source(spark, src), specs, out, at).awaitTermination()
        full = spark.createDataFrame(rows, PAGES)
        want = sorted(tuple(r) for r in corpus_pages(full, specs).select("site", "ord", "depth", "url", "content").collect())
        assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/ordered").select("site", "ord", "depth", "url", "content").collect()) == want
        pieces = build_corpus(full, specs, at).orderBy("site", "part", "chunk").collect()
        for site in {"a", "b"} & {r.site for r in pieces}:
            text = "".join(open(f).read() for f in sorted(glob.glob(f"{out}/documents/site={site}/part-*")))
            assert text == "".join(r.markdown for r in pieces if r.site == site)
        now = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/documents/**/part-*", recursive=True)}
        for site in {"a", "b"} - {r[1][8] for r in batch}:
            assert [now[f] for f in before if f"site={site}/" in f] == [t for f, t in before.items() if f"site={site}/" in f] != []
    assert len(want) == 7
