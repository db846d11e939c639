"""Queries that take what they need from the content of their tables."""

import duckdb
from pyspark.sql import functions as F

from corpusmill.plans.oracles import ORACLES
from corpusmill.plans.registry import QUERIES


def test_crawl_depths_by_content(spark, sf, tmp_path):
    """A page that has no content, whatever its number, is not reached."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    before = {r.url for r in QUERIES["crawl_depths"](spark, sf).collect()}
    gone = next(r.url for r in pages.select("page_id", "url").orderBy("page_id").collect() if r.url in before and r.page_id % 100)
    empty = F.regexp_replace("html", r"(?s)<article>.*?</article>", "<article> \n</article>")
    pages.withColumn("html", F.when(F.col("url") == gone, empty).otherwise(F.col("html"))).write.parquet(str(tmp_path / "pages.parquet"))
    after = {r.url for r in QUERIES["crawl_depths"](spark, str(tmp_path)).collect()}
    assert after <= before - {gone}


def test_documents_md_crawled_reaches_all(spark, sf):
    """All pages that links lead to are there, at any depth."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(ORACLES["documents_md_crawled"]).fetchall()
    got = QUERIES["documents_md_crawled"](spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and want
