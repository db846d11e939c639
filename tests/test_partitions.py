"""Queries that take html apart deal its pages out by bytes, so that a task has no more of them on larger tables."""

import pytest

from corpusmill.operators import tokens as T
from corpusmill.plans.registry import QUERIES

NAMES = (
    "crawl_depths", "to_markdown_tables", "absolute_link", "to_markdown_absolute_links", "missing_pages", "follow_edges", "to_markdown_crossed",
    "follow_edges_by_site", "to_markdown", "exclude_subtrees", "metadata_header", "table_of_contents", "page_count", "duplicate_groups",
    "crawl_summary", "extract_links_excluded", "page_sink",
)
PAGES, BYTES = 40, 1000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table of pages of about ``BYTES`` of html each."""
    path = tmp_path_factory.mktemp("dealt")
    html = "<title>t</title><nav><a href='/p1'>x</a></nav><article><h1>h</h1><p>{}</p></article>"
    rows = [(i, f"https://example.{('com', 'net', 'org')[i % 3]}/p{i}", html.format(f"{i} " + "x" * BYTES)) for i in range(PAGES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    return str(path)


class Dealt(Exception):
    """Into how many partitions pages would be dealt; raised so that nothing after that is run."""


@pytest.mark.parametrize("name", NAMES)
def test_pages_are_dealt_by_bytes(spark, folder, monkeypatch, name):
    def by_page(pages, key, n):
        raise Dealt(n)

    monkeypatch.setattr(T, "PARTITION_BYTES", 2 * BYTES)
    monkeypatch.setattr(T, "by_page", by_page)
    with pytest.raises(Dealt) as found:
        QUERIES[name](spark, folder)
    assert found.value.args[0] >= PAGES // 2
