import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpusmill.session import configure  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        configure(SparkSession.builder).master("local[8]")
        .appName("corpusmill-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        # tiny inputs: interpreting is faster than compiling
        .config("spark.sql.codegen.wholeStage", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def column(spark, rows, schema, fn):
    """Values of ``fn`` over the rows, in row order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row int, " + schema)
    return [r["out"] for r in df.select("_row", fn.alias("out")).orderBy("_row").collect()]
