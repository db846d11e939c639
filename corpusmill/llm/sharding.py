"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 64-bit hashes. A document stands on the ring at the hash of its
text (so that equal texts are neighbours) and belongs to the next point clockwise. No shard takes more than its
capacity; documents that overflow a full shard go on clockwise to the next shard with room.

Only the ring is known to the driver: one count for each of ``shards * vnodes`` arcs, however many documents
there are. Within an arc documents are ranked by range-partitioned running counts, so neither an arc nor a
text that a third of all rows share is ever in one task.

Defined results: NULL texts count as empty ones, equal rows are placed like any others, an empty table gives
an empty table, other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm.common import running, stored

SLOT_BITS = 12


def ring(spark: SparkSession, shards: int, vnodes: int, seed: str) -> list[tuple[int, int]]:
    """``(position, shard)`` of all virtual nodes in clockwise order; their number is a parameter."""
    points = spark.range(shards * vnodes).select(
        F.xxhash64(F.lit(seed), F.col("id")).alias("at"), F.floor(F.col("id") / vnodes).cast("int").alias("shard"))
    return sorted((r["at"], r["shard"]) for r in points.collect())


def place(counts: list[int], owners: list[int], capacity: list[int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Segments ``(first, end, shard, slot)`` of every arc: ranks ``first <= r < end`` of the arc go to ``shard``,
    the first of them to ``slot``.

    Round k offers what is left of each arc to the k-th point clockwise from it, arcs in ring order, so a document
    moves no further than it must.
    """
    room, used = list(capacity), [0] * len(capacity)
    segments: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    left = {arc: 0 for arc, n in enumerate(counts) if n}
    for step in range(len(owners)):
        for arc, done in list(left.items()):
            shard = owners[(arc + step) % len(owners)]
            n = min(room[shard], counts[arc] - done)
            if n:
                segments[arc].append((done, done + n, shard, used[shard]))
                room[shard] -= n
                used[shard] += n
            if done + n == counts[arc]:
                del left[arc]
            else:
                left[arc] = done + n
        if not left:
            break
    return segments


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """With no slack: exactly as many places as rows, at most one apart. Else (1 + slack) times the mean."""
    if not slack:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-(1 + slack) * rows // shards)] * shards


def assign_shards(docs: DataFrame, shards: int = 8, vnodes: int = 64, slack: float = 0.0, seed: str = "ring") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: one row per row of ``docs``.

    ``law`` is ``rows`` when there is no slack. Slots of a shard run from 0 without gaps.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    points = ring(spark, shards, vnodes, seed)
    at, owners = [p for p, _ in points], [s for _, s in points]
    first = [(slot << 64 - SLOT_BITS) - (1 << 63) for slot in range(1 << SLOT_BITS)]
    slots = spark.createDataFrame(
        [(k, (lo := bisect_left(at, begin)), at[lo:bisect_left(at, begin + (1 << 64 - SLOT_BITS))]) for k, begin in enumerate(first)],
        "__slot long, __base int, __points array<long>",
    )  # 4096 rows and shards * vnodes points, whatever the data
    narrow = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("__bytes"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__at"), F.xxhash64(F.lit(seed), "doc_id").alias("__order"),
    ).withColumn("__slot", F.shiftright(F.col("__at"), 64 - SLOT_BITS) + (1 << SLOT_BITS - 1))
    beyond = F.size(F.filter("__points", lambda p: p < F.col("__at")))
    on_arc = narrow.join(F.broadcast(slots), "__slot").select(
        "doc_id", "__bytes", "text_crc32", "__at", "__order", ((F.col("__base") + beyond) % len(points)).alias("__arc"),
        F.lit(1).alias("__one"),
    )
    ranked = stored(running(on_arc, ["__arc", "__at", "__order", "doc_id"], "__one", "__rank"))
    found = {r["__arc"]: r["n"] for r in ranked.groupBy("__arc").agg(F.count("*").alias("n")).collect()}
    counts = [found.get(arc, 0) for arc in range(len(points))]
    segments = place(counts, owners, capacities(sum(counts), shards, slack))
    before, rows = 0, []
    for arc, n in enumerate(counts):
        rows.append((arc, [(before + a, before + b, shard, slot) for a, b, shard, slot in segments[arc]]))
        before += n
    arcs = spark.createDataFrame(rows, "__arc int, __segments array<struct<first:long,end:long,shard:int,slot:long>>")
    mine = F.filter("__segments", lambda s: (s["first"] <= F.col("__rank")) & (F.col("__rank") < s["end"]))[0]
    return ranked.join(F.broadcast(arcs), "__arc").withColumn("__mine", mine).select(
        "doc_id", (F.col("__bytes") + 1).alias("size"), "text_crc32", F.lit("bounded" if slack else "rows").alias("law"),
        F.col("__mine.shard").alias("shard"), (F.col("__mine.slot") + F.col("__rank") - F.col("__mine.first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
