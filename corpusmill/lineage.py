"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Only a plain local session may fall back to a folder of its own; on a cluster a machine-local
    folder would be lost with its machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="corpusmill-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write narrow rows to the checkpoint folder and go on from there; how they are partitioned is kept.

    What a checkpoint also keeps is the plan's estimate of its size, for a join the product of both sides'. From round to round that becomes a
    number of millions of digits, which fills the driver, so the rows are taken without it.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    jvm, rows = spark.sparkContext._jvm, df.checkpoint(eager=True)._jdf.queryExecution().analyzed()
    nothing = jvm.scala.Option.empty()
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(
        rows.output(), rows.rdd(), rows.outputPartitioning(), rows.outputOrdering(), False, nothing, spark._jsparkSession, nothing, nothing)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def store(df: DataFrame) -> DataFrame:
    """Write wide rows to the checkpoint folder as Parquet, of which later steps read only the columns they need."""
    path = f"{checkpoint_dir(df.sparkSession)}/store-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all tables that :func:`store` wrote; call it when nothing built on them will be read again."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
