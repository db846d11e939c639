"""Page tables in, corpora and page tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def scan_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages from a Parquet, ORC or JSON table with the columns page_id, url, html."""
    return spark.read.schema(PAGES).format(fmt).load(path)


def scan_html_files(spark: SparkSession, path: str, root: str, base_url: str) -> DataFrame:
    """One page per HTML file: its URL is ``base_url`` plus the path below ``root``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    below = F.substring_index(name, root.rstrip("/") + "/", -1)
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), below)
    return files.select(F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))


def write_pages(pages: DataFrame, path: str, by: str = "site", mode: str = "overwrite") -> None:
    """Structured page records, one folder per site."""
    pages.write.mode(mode).partitionBy(by).parquet(path)


def save_bucketed(pages: DataFrame, table: str, buckets: int, key: str = "page_id") -> None:
    """Pages as a table bucketed by page key: the HTML operators then read it without any exchange."""
    pages.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).saveAsTable(table)


def write_corpus(parts: DataFrame, path: str, specs: DataFrame | None = None) -> None:
    """Write the pieces of documents as text files, one folder per site, or per ``output_file`` if ``specs`` are given.

    Rows are range-partitioned in document order, so a large site is spread over several tasks
    and files; the files of a folder, read in name order, are the document. Every piece ends with
    a line end, which the text writer supplies itself.
    """
    by = "site"
    if specs is not None:
        by = "output_file"
        parts = parts.join(specs.select(F.col("name").alias("site"), "output_file"), "site")
    body: Column = F.regexp_replace("markdown", r"\n\z", "")
    order = list(dict.fromkeys([by, "site", "part", "chunk"]))
    (
        parts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(by, body.alias("value"))
        .write.mode("overwrite").partitionBy(by).text(path)
    )
