"""The sorted digest array: built once, mapped once per worker, hits confirmed on stored strings."""

import os
import pickle

import pyarrow as pa
from pyspark.sql import types as T

from corpusmill.llm import url_filter
from corpusmill.llm.url_filter import DigestArray, filter_urls

RULES = [("block" if k % 3 else "allow", f"host{k}.example/{'p' * (k % 4)}/") for k in range(500)]


def test_array_travels():
    table = DigestArray.arrived(pickle.loads(pickle.dumps(DigestArray(RULES).packed())))
    assert [table.keys[k] for k in range(table.n)] == sorted(table.keys.tolist())
    assert {(table.verdict(k), table.rule(k)) for k in range(table.n)} == set(RULES)
    places = table.look_up([(r.split("/")[0], "/" + r.split("/", 1)[1] + "x") for _, r in RULES] + [("other.example", "/")])
    assert [(table.verdict(k), table.rule(k)) for k in places[:-1]] == RULES and places[-1] == -1


def test_equal_digests(monkeypatch):
    """All digests collide: the stored strings decide."""
    monkeypatch.setattr(url_filter, "digest", lambda rule: 7)
    table = DigestArray(RULES)
    places = table.look_up([("host8.example", "//"), ("a.host9.example", "/p/q"), ("host9.example", "/q")])
    assert [table.rule(k) if k >= 0 else None for k in places] == ["host8.example//", "host9.example/p/", None]


def test_one_mapping_per_worker(spark):
    shipped = spark.sparkContext.broadcast(DigestArray(RULES).packed())

    def look(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "array": [id(DigestArray.arrived(shipped.value))]})

    seen = spark.range(0, 64, 1, 64).mapInArrow(look, "pid long, array long").collect()
    assert len(seen) == 64 and len(set(map(tuple, seen))) == len({r.pid for r in seen})


def test_empty_tables_and_no_rules(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType())])
    empty = filter_urls(spark.createDataFrame([], schema))
    assert empty.collect() == [] and empty.columns == ["page_id", "host", "path", "rule", "verdict"]
    some = filter_urls(spark.createDataFrame([(1, "https://A.net/x?y", "z"), (2, None, "z")], schema), rules=[], default="block")
    assert {tuple(r) for r in some.collect()} == {(1, "a.net", "/x", None, "block"), (2, "", "", None, "block")}
