"""Every operator and stage over NULLs, empty and long texts, ties, equal rows, empty tables and clashing names."""

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from corpusmill.llm.decontamination import contamination, decontaminate
from corpusmill.llm.line_dedup import repeated_lines
from corpusmill.llm.mixing import mix, mixture
from corpusmill.llm.near_duplicates import drop_near_duplicates, near_duplicates
from corpusmill.llm.paragraph_dedup import repeated_paragraphs
from corpusmill.llm.quality import filter_quality, quality
from corpusmill.llm.sharding import assign_shards
from corpusmill.llm.suffix_dedup import without_repeats
from corpusmill.llm.toxicity import fit, reject_toxic, score
from corpusmill.llm.url_filter import filter_urls

from .conftest import prose

LONG = " ".join(prose(5, 30_000))
ROWS = [
    (1, None, None, None), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one", "en", "a"), (4, "one", "en", "a"), (None, "no id " * 30, "en", "b"),
    (None, "no id " * 30, "en", "b"), (5, LONG, "en", "b"), (6, LONG + " tail", "de", "b"), (7, "\u00e9\U0001F600 \x00 x", "fr", "c"), (7, "same id, other text", "fr", "c"),
]


@pytest.fixture(scope="module")
def edge(docs_of):
    return docs_of(ROWS)


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (6, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one"), (3, "one"), (None, "same ID")], "item_id long, text string")


def test_one_row_each(edge, labels, items):
    for result in (
        without_repeats(edge), near_duplicates(edge), score(edge, fit(edge, labels)), quality(edge), contamination(edge, items), mixture(edge), assign_shards(edge),
    ):
        assert result.count() == len(ROWS)


def test_values(edge, items):
    hits = {(r.doc_id, r.n_words): r for r in contamination(edge, items).collect()}
    assert hits[4, 1].n_hit == 1 and hits[4, 1].n_items == 1 and hits[7, 4].n_items == 1 and hits[1, 0].n_hit == 0
    near = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(edge).collect()]
    assert sorted(near, key=str) == sorted([
        (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (None, None, True), (None, None, True), (5, 5, True), (6, 5, False),
        (7, 7, True), (7, 7, True)], key=str)
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in without_repeats(edge).collect()}
    assert cut[5, len(LONG)] == len(LONG) and cut[6, len(LONG) + 5] == len(LONG) and cut[1, 0] == 0
    # equal rows are judged alike: both copies of the row without an id stay
    assert [r.doc_id for r in repeated_lines(edge).filter("NOT kept").collect()] == [6]
    assert [r.doc_id for r in repeated_paragraphs(edge).filter("NOT block AND NOT kept").collect()] == [6]
    shards = assign_shards(edge).collect()
    assert sorted(s.slot for s in shards if s.shard == 0) == list(range(sum(s.shard == 0 for s in shards)))


def test_filters_keep_columns(edge, labels, items):
    for result, n in (
        (drop_near_duplicates(edge), 8), (reject_toxic(edge, labels), None), (filter_quality(edge), None), (decontaminate(edge, items), 8), (mix(edge), None),
    ):
        assert result.columns == edge.columns
        assert n is None or result.count() == n
        result.collect()


def test_empty_tables(nothing, labels, items, spark):
    for result in (
        without_repeats(nothing), repeated_paragraphs(nothing), near_duplicates(nothing), score(nothing, fit(nothing, labels)), repeated_lines(nothing),
        quality(nothing), contamination(nothing, items), mixture(nothing), assign_shards(nothing), drop_near_duplicates(nothing),
        reject_toxic(nothing, labels.limit(0)), filter_quality(nothing), decontaminate(nothing, items.limit(0)), mix(nothing),
    ):
        assert result.count() == 0


def test_urls(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("rule", T.StringType()))])
    rows = [(2**60 + 1, "http://A.Example.NET/en/x?y"), (2, None), (3, ""), (4, "no scheme"), (5, "http://example.net"), (6, "x://b.c.org/fr/"), (6, "x://b.c.org/fr/"),
            (7, "http://badexample.com/de/"), (8, "http://net/en/"), (None, "a://example.com/de/#" + "z" * 100_000)]
    got = [tuple(r) for r in filter_urls(spark.createDataFrame([(*r, "q") for r in rows], schema)).collect()]
    assert sorted(got, key=str) == sorted([
        (2**60 + 1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "example.net", "", None, "allow"), (6, "b.c.org", "/fr/", "org/fr/", "allow"), (6, "b.c.org", "/fr/", "org/fr/", "allow"),
        (7, "badexample.com", "/de/", None, "allow"), (8, "net", "/en/", "net/", "block"), (None, "example.com", "/de/", "example.com/de/", "block"),
    ], key=str)
    small = filter_urls(spark.createDataFrame([(*r, "q") for r in rows], schema), max_rules=1)
    assert sorted((tuple(r) for r in small.collect()), key=str) == sorted(got, key=str)


def test_pipeline_stages(edge, labels, items, spark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (edge, edge.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, str(tmp_path))
            assert name == "sharding" or result.columns == docs.columns
            result.collect()
