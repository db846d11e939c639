"""Documents that follow a stream of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.lineage import store
from corpusmill.operators.document import assemble
from corpusmill.operators.links import dedup_urls
from corpusmill.plans.build import convert_sites, locate, ordered_pages, split_specs


def stream_documents(
    pages: DataFrame, specs: DataFrame, out: str, generated_at: str, dedup_on: str = "rendered", start_depth: int = 1,
) -> StreamingQuery:
    """Keep ``out/ordered`` (the pages of every document) and ``out/documents`` (text, one folder per site) up to date.

    A batch takes apart the html it brings and nothing else; what comes out is kept, by batch. The sites it touches are put
    together again out of all that was kept of them: depths along their links, contents, order and sections. Their folders
    are overwritten, those of other sites are not looked at. After every batch the documents are those that a
    full build of all pages so far would make. Repeating a batch overwrites what it has kept.
    """
    valid, _ = split_specs(specs)

    def follow(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = store(batch)
        locate(rows, valid).write.mode("overwrite").parquet(f"{out}/located/batch={batch_id}")
        convert_sites(rows, valid).write.mode("overwrite").parquet(f"{out}/converted/batch={batch_id}")
        touched = store(spark.read.parquet(f"{out}/located/batch={batch_id}").select("site").distinct())
        mine = lambda table: spark.read.parquet(f"{out}/{table}").drop("batch").join(touched, "site", "left_semi")
        # equal URLs of a site are one page, whichever batches bring them
        kept = dedup_urls(mine("located"), by=("site",)).select("site", "page_id")
        converted = store(mine("converted").join(kept, ["site", "page_id"], "left_semi").dropDuplicates(["site", "page_id"]))
        own = valid.join(touched.withColumnRenamed("site", "name"), "name", "left_semi")
        ordered = store(ordered_pages(converted, own, converted, dedup_on, start_depth))
        by_site = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site")
        by_site(ordered).parquet(f"{out}/ordered")
        order = ["site", "part", "chunk"]
        pieces = assemble(ordered, own, generated_at).repartitionByRange(*order).sortWithinPartitions(*order)
        by_site(pieces.select("site", F.regexp_replace("markdown", r"\n\z", "").alias("value"))).text(f"{out}/documents")

    return (
        pages.writeStream.foreachBatch(follow).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
