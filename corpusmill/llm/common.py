"""What several operators need: shared intermediate tables, document keys, running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Fixed value: a word is a run of anything but ASCII white space (ranges are much faster than their complement).
WORD = r"[\x00-\x08\x0E-\x1F\x21-\x{10FFFF}]++"


# Spark's own switch: files of a query's shuffles are removed when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile leave no shuffle files, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session in which it is unset gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder as Parquet and go on from there.

    Lineage ends at the files, which a lost executor does not take with it. The folder is the
    caller's to empty: a lazy result may still read it. Shuffle files go when the rows are written.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`stored` wrote, when all that was made of them is stored as well."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent()
        if not folder.getName().startswith("llm-"):
            raise ValueError(f"not a stored table: {folder}")
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """64 bits of a text; with the ``doc_id`` it names a row. NULL and empty texts are told apart."""
    return F.xxhash64(text, text.isNull())


def keyed(docs: DataFrame) -> tuple[Column, Column]:
    """Expressions that name a row of ``docs`` in a table of decisions."""
    return docs["doc_id"], text_key(docs["text"])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, decisions: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` that ``decisions`` (``__id, __text``) names, or with ``left_anti`` the others.

    Columns of ``docs`` stay as they are, whatever their names.
    """
    doc_id, text = keyed(docs)
    return docs.join(decisions, doc_id.eqNullSafe(decisions["__id"]) & (text == decisions["__text"]), how)


def running(
    df: DataFrame, order: Sequence[str], value: str, out: str, by: str | None = None, partitions: int | None = None,
) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before this one in ``order``, within ``by``.

    Rows are dealt by ranges of (by, order), so a group of any size is spread over many tasks; what
    stands before each range is one row per group and range. ``by`` must not be NULL.
    """
    group = [by] if by else []
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *group, *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", *group, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inside.join(offsets, ["__part", *group])
    return joined.withColumn(out, F.col("__within") + F.col("__offset")).drop("__part", "__within", "__offset")


def with_classes(rows: DataFrame, classes: DataFrame, key: Sequence[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``classes``, which has one row for each ``key`` and in ``count`` how many of the rows have it.

    A key of more than a thousandth of all rows would be one large task. There are at most a thousand such keys, by
    arithmetic, so theirs are broadcast; the others meet in a shuffle. Both tables are read twice and should be stored.
    """
    total = classes.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * 1000 > total
    many, few = F.broadcast(classes.filter(heavy).drop(count)), classes.filter(~heavy).drop(count)
    rest = rows.join(F.broadcast(classes.filter(heavy).select(*key)), list(key), "left_anti")
    return rows.join(many, list(key)).unionByName(rest.join(few, list(key)))


def outside_classes(rows: DataFrame, classes: DataFrame, key: Sequence[str], count: str) -> DataFrame:
    """Rows whose key is not in ``classes``; as in :func:`with_classes` no large group of rows is shuffled by its key."""
    total = classes.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * 1000 > total
    rest = rows.join(F.broadcast(classes.filter(heavy).select(*key)), list(key), "left_anti")
    return rest.join(classes.filter(~heavy).select(*key), list(key), "left_anti")
