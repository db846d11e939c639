"""Pages that arrive over time.

New page files are a stream, each micro-batch runs the batch operators, and what has been seen
lives in tables or in the state store, both below the folder the caller names (a shared one on a
cluster).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions.text import content_hash
from corpusmill.operators.corpus import milestones, order_pages
from corpusmill.sources.pages import PAGES


def page_source(spark: SparkSession, path: str, name: str | None = None, max_files: int = 1000) -> DataFrame:
    """A stream of page rows from Parquet files; ``name`` restricts it to the table of that name below ``path`` (:func:`table_path`)."""
    reader = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files)
    return reader.parquet(table_path(path, name) if name else path)


def table_path(path: str, name: str) -> str:
    """The path of a table to stream from, whether it is one file or a folder of files.

    It is written as a pattern: a stream takes a plain path for a folder, and a filter of file names finds nothing where the folder has the name.
    """
    return f"{path.rstrip('/')}/{{{name}}}"


def stream_pages(
    pages: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, dedup_on: str | None = None,
) -> StreamingQuery:
    """Run ``transform`` on every micro-batch and add its rows to ``out/pages``.

    Every batch writes its own folder and overwrites it when it is repeated, so a restart adds
    nothing twice, and no batch reads what earlier ones wrote. With ``dedup_on`` rows carry
    ``content_hash`` and equal contents of one batch are one row; :func:`stream_first_copies` drops those
    that an earlier batch has brought.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch)
        if dedup_on:
            rows = rows.withColumn("content_hash", content_hash(F.col(dedup_on)))
            first = F.min_by(F.struct(*rows.columns), "url")
            rows = rows.groupBy("content_hash").agg(first.alias("first")).select("first.*")
        rows.write.mode("overwrite").parquet(f"{out}/pages/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )


def stream_first_copies(spark: SparkSession, out: str) -> StreamingQuery:
    """A second stream over ``out/pages``: the first row to arrive of every ``content_hash``, added to ``out/distinct``.

    What has been seen is one hash per content in the state store, so a batch costs what it brings. Which copy
    of a content stays depends on the order of arrival; the set of contents does not.
    """
    schema = spark.read.parquet(f"{out}/pages").schema
    rows = spark.readStream.schema(schema).parquet(f"{out}/pages").drop("batch")
    return (
        rows.dropDuplicates(["content_hash"]).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint-distinct")
        .option("path", f"{out}/distinct").outputMode("append").trigger(availableNow=True).start()
    )


def stream_distinct_hashes(rows: DataFrame, content: str, out: str, keep: tuple[str, ...] = ()) -> StreamingQuery:
    """First-seen contents of a stream: the state store holds one hash per distinct content.

    The state never shrinks, as the set of seen contents must not; :func:`stream_recent_hashes` has a bounded one.
    """
    distinct = rows.select(content_hash(F.col(content)).alias("content_hash"), *keep).dropDuplicates(["content_hash"])
    return (
        distinct.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
        .option("path", f"{out}/hashes").outputMode("append").trigger(availableNow=True).start()
    )


def stream_recent_hashes(rows: DataFrame, content: str, out: str, time: str, horizon: str, keep: tuple[str, ...] = ()) -> StreamingQuery:
    """Contents that were not seen shortly before, with a state that only holds what is recent.

    ``time`` is the event time of a row (:func:`with_file_time` gives that of its file). A content is a copy as long as the stream's clock, the latest
    event time less ``horizon``, has not passed ``horizon`` after the copy that was kept; then it is forgotten, and the next one is
    kept again. Rows that are older than the clock itself are left out.
    """
    hashed = rows.select(F.col(time).alias("seen"), content_hash(F.col(content)).alias("content_hash"), *keep)
    distinct = hashed.withWatermark("seen", horizon).dropDuplicatesWithinWatermark(["content_hash"])
    return (
        distinct.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
        .option("path", f"{out}/hashes").outputMode("append").trigger(availableNow=True).start()
    )


def with_file_time(rows: DataFrame, name: str = "arrived") -> DataFrame:
    """Add when a row's file was written, as event time."""
    return rows.withColumn(name, F.col("_metadata.file_modification_time"))


def stream_progress(pages: DataFrame, out: str, order: tuple[str, ...] = ("depth", "url"), every: int = 10) -> StreamingQuery:
    """Milestones of a stream: every tenth processed page, added to ``out/milestones``, and what each batch brought, to ``out/progress``.

    Batches are numbered on, one after the other, and pages of a batch in ``order``. A batch is counted by a metric that is observed while its rows
    are written, so it is read once; the next one finds the sum in the table. Repeating a batch overwrites its folders.
    """

    def note(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        progress = spark.read.schema("pages long, batch long").option("basePath", f"{out}/progress").parquet(f"{out}/progress") if batch_id else None
        before = (progress.filter(F.col("batch") < batch_id).agg(F.sum("pages")).first()[0] if progress else None) or 0
        seen = Observation("progress")
        numbered = order_pages(batch.withColumn("_all", F.lit(0)), by=("_all",), order=order).withColumn("ord", F.col("ord") + before)
        marked = milestones(numbered.observe(seen, F.count(F.lit(1)).alias("pages")), every)
        marked.drop("_all").write.mode("overwrite").parquet(f"{out}/milestones/batch={batch_id}")
        count = spark.range(1).select(F.lit(seen.get["pages"]).cast("long").alias("pages"))
        count.write.mode("overwrite").parquet(f"{out}/progress/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(note).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )


def stream_counts(rows: DataFrame, by: str, out: str, compact_every: int = 16) -> StreamingQuery:
    """Running number of pages per group, as a log: each batch adds the new totals of the groups it touched to ``out/changes``.

    So a batch writes as much as it brings. Every ``compact_every`` batches the log is folded into ``out/totals`` and what
    it was made of is removed. Folders are named by batch and overwritten if one is repeated; :func:`latest_counts` reads both.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            _compact(batch.sparkSession, out, batch_id)

    counts = rows.groupBy(by).agg(F.count("*").alias("pages"))
    return (
        counts.writeStream.outputMode("update").foreachBatch(add)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """Complete batch folders below ``path``, by number."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("batch=")]
    return {int(f.getName()[6:]): f.toString() for f in found if files.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))}


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _log(spark: SparkSession, out: str) -> tuple[DataFrame | None, list[str], int]:
    """Totals and later changes with their batch, the folders they are in, and the last batch."""
    totals, changes = _folders(spark, f"{out}/totals"), _folders(spark, f"{out}/changes")
    upto = max(totals, default=-1)
    used = {**({upto: totals[upto]} if totals else {}), **{k: v for k, v in changes.items() if k > upto}}
    parts = [spark.read.parquet(path).withColumn("batch", F.lit(k)) for k, path in sorted(used.items())]
    return (reduce(DataFrame.unionByName, parts) if parts else None), [*totals.values(), *[v for k, v in changes.items()]], max(used, default=-1)


def _compact(spark: SparkSession, out: str, batch_id: int) -> None:
    rows, folders, last = _log(spark, out)
    _latest(rows).write.mode("overwrite").parquet(f"{out}/totals/batch={batch_id}")
    for path in folders:
        if path.rstrip("/") != _folders(spark, f"{out}/totals").get(batch_id, "").rstrip("/"):
            _remove(spark, path)


def _latest(rows: DataFrame) -> DataFrame:
    keys = [c for c in rows.columns if c not in ("pages", "batch")]
    return rows.groupBy(*keys).agg(F.max_by("pages", "batch").alias("pages"))


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The totals after the last batch of :func:`stream_counts`."""
    return _latest(_log(spark, out)[0])
