"""Merkle manifest of a dataset, with checkpoints at every few levels and proofs by recomputing what lies between.

Every row is a leaf, the SHA-256 of its fields. Leaves of a group are ordered and numbered; two consecutive nodes become their common hash, a
last one alone becomes its own, until one is left: the group's subroot. Subroots are the leaves of one more tree, whose top is the root.

Of the levels only every ``stride``-th is written. The 2**stride nodes below one written node are an aligned block, and all
work is done by blocks: building reads a block and writes its top; proving reads the block again together with the path of its top,
regenerates the levels between, emits for every node its siblings and forgets them. So neither step has more than a block in memory, a tree
of any size is as many passes as it has written levels, and each pass reads a ``2**stride``-th of the one before.

A hash is in lowercase hexadecimal digits, and hashes are taken of such digits; tables keep 32 bytes. A field is ``-`` if NULL,
else its UTF-8 byte count, ``:`` and its value. Defined results: NULL groups and NULL order keys are first; leaves with equal order keys
are ordered by their hash, and rows that are equal in all fields have equal leaves with a place each; empty and long texts are fields like others; an empty
table has no leaf, no subroot and no root; other columns are not looked at. What cannot be changed without a trace is the
fields, the order and the number of rows of every group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import running, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Hash of the fields, in hexadecimal digits."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """Text that orders like the group, NULL first and told apart from the empty text."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


@dataclass(frozen=True)
class Forest:
    """Trees, one for each ``group``; ``levels[i]`` has ``group, pos, digest`` of every ``stride * i``-th level, the first one ``carried`` columns as well."""

    levels: list[DataFrame]
    stride: int
    carried: tuple[str, ...]


@dataclass(frozen=True)
class Manifest:
    """A tree for each group of rows (``rows``), and one over their subroots (``groups``)."""

    rows: Forest
    groups: Forest

    def root(self) -> str | None:
        """The hash of everything; ``None`` if there is nothing."""
        top = self.groups.levels[-1].first()
        return bytes(top["digest"]).hex() if top else None


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def subtree(nodes: list[str], alone: bool, stride: int) -> list[list[str]]:
    """All levels of a block from ``nodes`` up; the only block of a tree ends with its first single node."""
    levels = [nodes]
    while len(levels) <= stride and not (alone and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([_hash(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one block together; they come sorted by ``group, block``."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = pc.and_(*[pc.equal(batch[c].slice(1), batch[c].slice(0, batch.num_rows - 1)) for c in ("group", "block")])
        edges = [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        if kept and any(kept[0][c][0] != batch[c][0] for c in ("group", "block")):
            yield pa.Table.from_batches(kept).combine_chunks()
            kept = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept = []
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _is_alone(block: int, n: int, stride: int) -> bool:
    # blocks fill up in order, so a first block that is not full has none after it; of a full one both rules make the same
    return block == 0 and n < 1 << stride


def _tops(stride: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block = table["block"][0].as_py()
            nodes = [d.hex() for d in table["digest"].to_pylist()]
            top = subtree(nodes, _is_alone(block, len(nodes), stride), stride)[-1][0]
            yield pa.RecordBatch.from_arrays([table["group"].chunk(0)[:1], pa.array([block], pa.int64()), pa.array([bytes.fromhex(top)], pa.binary())], ["group", "pos", "digest"])

    return fold


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("group", "block").sortWithinPartitions("group", "block", "pos")


def plant(leaves: DataFrame, order: Sequence[str], carried: Sequence[str] = (), stride: int = 8) -> Forest:
    """The trees over ``leaves`` (``group, digest`` and the other columns named), written level by level."""
    numbered = running(leaves.withColumn("__one", F.lit(1)), [*order, "digest"], "__one", "pos", by="group")
    levels = [stored(numbered.select("group", "pos", "digest", *carried))]
    while not levels[-1].filter("pos > 0").isEmpty():
        nodes = levels[-1].select("group", F.shiftright("pos", stride).alias("block"), "pos", "digest")
        levels.append(stored(_by_block(nodes).mapInArrow(_tops(stride), "group string, pos long, digest binary")))
    return Forest(levels, stride, tuple(carried))


def build_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", stride: int = 8, carry: Mapping[str, Column] | None = None,
) -> Manifest:
    """The manifest of ``docs``; ``carry`` are expressions over its rows that are kept beside the leaves, under names of their own."""
    carry = dict(carry or {})
    leaves = stored(docs.select(
        group_key(docs[group]).alias("group"), F.unhex(leaf_digest(*[docs[f] for f in fields])).alias("digest"), docs[order].alias("__order"),
        *[value.alias(name) for name, value in carry.items()]))
    rows = plant(leaves, ["__order"], ["__order", *carry], stride)
    subroots = rows.levels[-1].select(F.lit("").alias("group"), F.col("group").alias("member"), "digest")
    return Manifest(rows, plant(subroots, ["member"], ["member"], stride))


PATH = "siblings array<string>, left array<boolean>, subroot string, root string"


def _paths(stride: int, carried: Sequence[str]):
    """For every node of a block its siblings up to the block's top, then those of the top, which the block's first row brings."""

    def regenerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            top, table = table.slice(0, 1), table.slice(1)
            n = table.num_rows
            if not n:
                continue
            levels = subtree([d.hex() for d in table["digest"].to_pylist()], _is_alone(table["block"][0].as_py(), n, stride), stride)
            above, above_left = top["siblings"][0].as_py(), top["left"][0].as_py()
            inside = len(levels) - 1
            # one pool of hashes, and for every node and level the sibling's place in it, or none
            pool, at, left = [x for level in levels[:-1] for x in level] + above, np.full((n, inside + len(above)), -1), np.zeros((n, inside + len(above)), bool)
            place, start = np.arange(n), 0
            for j, level in enumerate(levels[:-1]):
                other = (place >> j) ^ 1
                at[:, j] = np.where(other < len(level), start + other, -1)
                left[:, j] = (place >> j & 1).astype(bool)
                start += len(level)
            at[:, inside:] = start + np.arange(len(above))
            left[:, inside:] = above_left
            offsets = pa.array(np.arange(n + 1) * at.shape[1], pa.int32())
            siblings = pa.array(pool, pa.string()).take(pa.array(at.ravel(), mask=at.ravel() < 0))
            yield pa.RecordBatch.from_arrays(
                [*[table[c].combine_chunks() for c in ("group", "pos", "digest", *carried)], pa.ListArray.from_arrays(offsets, siblings),
                 pa.ListArray.from_arrays(offsets, pa.array(left.ravel())), *[pa.array([top[c][0].as_py()] * n, pa.string()) for c in ("subroot", "root")]],
                ["group", "pos", "digest", *carried, "siblings", "left", "subroot", "root"])

    return regenerate


def _descend(forest: Forest, tops: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Leaves of ``forest`` with their paths, from those of its ``tops`` (``group`` and the columns of ``PATH``) down."""
    paths = tops.withColumn("pos", F.lit(0).cast("long"))
    for number, level in reversed(list(enumerate(forest.levels))):
        carried = forest.carried if number == 0 else ()
        nodes = level.select("group", F.shiftright("pos", forest.stride).alias("block"), "pos", "digest", *carried)
        if wanted is not None:
            blocks = wanted.select("group", F.shiftright("pos", forest.stride * (number + 1)).alias("block")).distinct()
            nodes = nodes.join(blocks, ["group", "block"], "left_semi")
        # the path of a block's top sorts before its nodes
        heads = paths.select("group", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "siblings", "left", "subroot", "root")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in level.select("group", "pos", "digest", *carried).schema)
        paths = _by_block(nodes.unionByName(heads, allowMissingColumns=True)).mapInArrow(_paths(forest.stride, carried), f"{kinds}, {PATH}")
    return paths


def prove(manifest: Manifest, wanted: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``key, group, pos, leaf, siblings, left, subroot, root`` and carried columns: the proof of every row, or of rows whose key is in ``wanted``.

    ``siblings`` are from the leaf's up to the one below the root, NULL where a node was alone; ``left`` says on which side each stands.
    """
    empty = F.array().cast("array<string>"), F.array().cast("array<boolean>")
    top = manifest.groups.levels[-1].select("group", empty[0].alias("siblings"), empty[1].alias("left"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    subroots = _descend(manifest.groups, top).select(F.col("member").alias("group"), "siblings", "left", F.lower(F.hex("digest")).alias("subroot"), "root")
    places, rows = None, manifest.rows
    if wanted is not None:
        keys = wanted.select(F.col(key).alias("__key")).distinct()
        places = stored(rows.levels[0].join(keys, F.col("__order").eqNullSafe(F.col("__key")), "left_semi").select("group", "pos"))
    found = _descend(rows, subroots, places)
    if places is not None:
        found = found.join(places, ["group", "pos"], "left_semi")
    carried = [c for c in rows.carried if c != "__order"]
    return found.select(F.col("__order").alias(key), "group", "pos", F.lower(F.hex("digest")).alias("leaf"), "siblings", "left", "subroot", "root", *carried)


def folded(leaf: Column, siblings: Column, left: Column) -> Column:
    """The root that a leaf has with these siblings."""

    def join(digest: Column, step: Column) -> Column:
        other = step["sibling"]
        return F.sha2(F.when(other.isNull(), digest).when(step["left"], F.concat(other, digest)).otherwise(F.concat(digest, other)), 256)

    steps = F.zip_with(siblings, left, lambda s, side: F.struct(s.alias("sibling"), side.alias("left")))
    return F.aggregate(steps, leaf, join)


def proof_digest(siblings: Column) -> Column:
    """Hash of all siblings, from the leaf's up."""
    return F.sha2(F.array_join(siblings, ""), 256)
