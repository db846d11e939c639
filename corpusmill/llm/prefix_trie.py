"""Prefix trie of conversations by burst tries.

A turn is the 128-bit hash of its role and text, a conversation a row of turns, cut into segments of ``SEGMENT`` turns, so that a
conversation of any length is many rows of bounded size. What a segment hangs on, its head, is named by all segments before it. Under a head, equal
segments are one from the start, whatever number of conversations share them.

Suffixes with the same head and next turn are a container. A container of more than ``limit`` different suffixes is burst: its turn becomes a node of its own,
which is the head of what follows, and its suffixes stand in new containers by the turn after. No container can be burst more
than ``SEGMENT`` times. Those that remain are sorted and swept: a stack of open nodes, closed where the next suffix leaves them. A container
is the most that a task has to hold.

Sums over subtrees are made in the sweep as far as a container goes. Burst nodes and nodes on which a further segment hangs are junctions; their sums
come together by doubling: in round ``k`` a junction takes what its descendants at distance ``2**k`` have collected, so the number of rounds is the logarithm
of the depth. A junction inside a container then adds its sum to the at most ``SEGMENT`` nodes above it.

Defined results: turns of a conversation are ordered by ``turn``, NULL first, equal ones by role and by the hash of the text; NULL roles and texts are
empty; equal rows are turns like others; rows without a ``conv_id`` belong to no conversation; a conversation without
turns ends at the root; an empty table has no node, not even a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import WORD, outside_classes, running, stored, with_classes

SEGMENT = 64
ROOT = bytes(16)
# Conversation ids that go into one piece of the text whose hash is taken.
PIECE = 100_000


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that name a turn."""
    return _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, id, words``: the turns of every conversation, numbered from 0, without their texts; stored."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = stored(conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), turn_id(role, text).alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).alias("one")))
    return stored(running(narrow, ["turn", "role", "id"], "one", "place", by="conv_id").select("conv_id", "place", "id", "words"))


def rebuilt(turns: DataFrame, every: int = 20, heads: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, id, words`` of conversations that begin like another, and all ``conv_id``.

    The first ``heads`` (an expression over ``conv_id``, of three at most) turns are those of the conversation whose id is the next lower multiple of
    ``every``, as far as it has them; then come a conversation's own after as many.
    """
    heads = F.crc32(F.col("conv_id").cast("string")) % 4 if heads is None else heads
    convs = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % every))
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < 3)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "words"))).alias("head"))
    headed = stored(convs.join(first, "base", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, cast(h AS int))")).select("conv_id", "n", "h", "head"))
    begun = headed.select("conv_id", F.explode("head").alias("t")).select("conv_id", (F.col("t.place") + 1).alias("depth"), "t.id", "t.words")
    rest = with_classes(turns, headed.select("conv_id", "n", "h", F.size("head").alias("given")), ["conv_id"], "n").filter("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("given") + 1).alias("depth"), "id", "words")
    return begun.unionByName(rest), convs.select("conv_id")


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """``conv_id, depth, head, turns, next, last``: ``next`` is the head of the segment after this one; stored."""
    at = F.expr(f"(depth - 1) div {segment}")
    cut = stored(turns.groupBy("conv_id", at.alias("number")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("depth", "id", "words"))), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns")))
    if cut.filter("number > 0").isEmpty():
        return cut.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("head"), "turns", F.lit(None).cast("binary").alias("next"), F.lit(True).alias("last"))
    ids = F.concat(F.encode(F.col("number").cast("string"), "utf-8"), F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "").cast("binary"))
    # a name for all full segments up to one is made of sums of hashes, which many tasks can build together; 63 bits each, as decimals that cannot overflow
    sums = cut.filter(F.size("turns") == segment).select(
        "conv_id", "number", *[F.shiftrightunsigned(F.xxhash64(F.lit(i), ids), 1).cast("decimal(19,0)").alias(f"h{i}") for i in range(2)])
    before = running(running(sums, ["number"], "h0", "s0", by="conv_id"), ["number"], "h1", "s1", by="conv_id")
    after = F.col("number") + 1
    named = stored(before.select("conv_id", "number", _digest(F.concat_ws(
        ":", after.cast("string"), (F.col("s0") + F.col("h0")).cast("string"), (F.col("s1") + F.col("h1")).cast("string")).cast("binary")).alias("next")))
    befores = named.select("conv_id", after.alias("number"), F.col("next").alias("head"))
    full = cut.join(befores, ["conv_id", "number"], "left").join(named, ["conv_id", "number"], "left")
    # a full segment may still be the last one
    follows = cut.filter("number > 0").select("conv_id", (F.col("number") - 1).alias("number"), F.lit(True).alias("follows"))
    return stored(full.join(follows, ["conv_id", "number"], "left").select(
        "conv_id", (F.col("number") * segment).alias("depth"), F.coalesce("head", F.lit(ROOT)).alias("head"), "turns", "next", F.col("follows").isNull().alias("last")))


def _suffixes(segments: DataFrame) -> DataFrame:
    """``row, head, depth, turns, next, conv, n, ends, goes_on``: one row for each different segment under a head; stored.

    ``row`` names it, ``n`` conversations have it, the smallest is ``conv``; of ``ends`` ones it is the last segment.
    """
    ids = F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "").cast("binary")
    return segments.withColumn("row", _digest(F.col("head"), ids)).select("conv_id", "row", "head", "depth", "turns", "next", "last")


def _collapsed(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("row").agg(
        F.first("head").alias("head"), F.first("depth").alias("depth"), F.first("turns").alias("turns"), F.first("next").alias("next"),
        F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.max("last").alias("ends"), F.max(~F.col("last")).alias("goes_on")))


NODE = ("name binary, parent binary, depth long, conv long, n long, words long, row binary, parent_conv long, children long, leaves long, saved long, top boolean, "
        "junction boolean, above array<binary>")


class _Open:
    """A node of the container that is being swept."""

    def __init__(self, name: bytes, parent: _Open | None, depth: int, words: int):
        self.name, self.parent, self.depth, self.words = name, parent, depth, words
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.row, self.junction = None, False

    def close(self) -> None:
        if not self.children and not self.junction:
            self.leaves = 1
        self.saved += (self.n - 1) * self.words
        if self.parent:
            self.parent.children += 1
            self.parent.leaves += self.leaves
            self.parent.saved += self.saved
            self.parent.n += self.n
            self.parent.conv = min(x for x in (self.parent.conv, self.conv) if x is not None)


def child_name(name: bytes, turn: bytes) -> bytes:
    return hashlib.md5(name + turn).digest()


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of every container; rows come sorted by container and turns."""
    made: list[_Open] = []
    stack: list[_Open] = []
    path: list[bytes] = []
    head = key = None

    def flush() -> pa.RecordBatch:
        while stack:
            stack.pop().close()
        above = [None if not x.junction else _names_above(x) for x in made]
        out = pa.RecordBatch.from_arrays([
            pa.array([x.name for x in made], pa.binary()), pa.array([x.parent.name if x.parent else head for x in made], pa.binary()),
            *[pa.array([getattr(x, c) for x in made], pa.int64()) for c in ("depth", "conv", "n", "words")], pa.array([x.row for x in made], pa.binary()),
            pa.array([x.parent and x.parent.conv for x in made], pa.int64()), *[pa.array([getattr(x, c) for x in made], pa.int64()) for c in ("children", "leaves", "saved")],
            pa.array([x.parent is None for x in made], pa.bool_()), pa.array([x.junction for x in made], pa.bool_()), pa.array(above, pa.list_(pa.binary())),
        ], schema=SWEPT)
        made.clear()
        path.clear()
        return out

    for batch in batches:
        for own_head, depth, turns, after, conv, n, row, ends, goes_on in zip(
                *[batch[c].to_pylist() for c in ("head", "depth", "turns", "next", "conv", "n", "row", "ends", "goes_on")], strict=True):
            ids = [t["id"] for t in turns]
            if (own_head, ids[0]) != key:
                if made:
                    yield flush()
                head, key = own_head, (own_head, ids[0])
            same = 0
            while same < min(len(path), len(ids)) and path[same] == ids[same]:
                same += 1
            while len(stack) > same:
                stack.pop().close()
            del path[same:]
            for i in range(same, len(ids)):
                over = stack[-1] if stack else None
                stack.append(_Open(child_name(over.name if over else head, ids[i]), over, depth + i + 1, turns[i]["words"]))
                made.append(stack[-1])
                path.append(ids[i])
            end = stack[-1]
            end.n += n
            end.conv = conv if end.conv is None else min(conv, end.conv)
            end.row = row if ends else None
            if goes_on:
                end.junction, end.name = True, after
    if made:
        yield flush()


SWEPT = pa.schema([
    *[(n, pa.binary()) for n in ("name", "parent")], *[(n, pa.int64()) for n in ("depth", "conv", "n", "words")], ("row", pa.binary()),
    *[(n, pa.int64()) for n in ("parent_conv", "children", "leaves", "saved")], ("top", pa.bool_()), ("junction", pa.bool_()), ("above", pa.list_(pa.binary()))])


def _names_above(node: _Open) -> list[bytes]:
    out, at = [], node
    while at:
        out.append(at.name)
        at = at.parent
    return out


def _burst(suffixes: DataFrame, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (``name, parent, depth, conv, n, words, row``) of burst containers, and the suffixes in those that remain."""
    state, nodes, settled = suffixes, [], []
    first = F.col("turns")[0]
    while True:
        keyed = state.filter(F.size("turns") > 0).withColumn("turn", first["id"])
        sizes = keyed.groupBy("head", "turn").agg(F.count("*").alias("size"))
        large = stored(sizes.filter(F.col("size") > limit).withColumn("name", _digest(F.col("head"), F.col("turn"))))
        if large.isEmpty():
            settled.append(keyed.drop("turn"))
            return nodes, _union(settled)
        settled.append(outside_classes(keyed, large, ["head", "turn"], "size").drop("turn"))
        on = stored(with_classes(keyed, large, ["head", "turn"], "size"))
        ending = (F.size("turns") == 1) & F.col("ends")
        nodes.append(on.groupBy("name").agg(
            F.first("head").alias("parent"), F.first(F.col("depth") + 1).alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.first(first["words"]).alias("words"),
            F.max(F.when(ending, F.col("row"))).alias("row")))
        state = on.select("row", F.col("name").alias("head"), (F.col("depth") + 1).alias("depth"), F.expr("slice(turns, 2, size(turns))").alias("turns"), "next", "conv", "n", "ends", "goes_on")


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _collected(junctions: DataFrame) -> DataFrame:
    """``name, leaves, saved`` with the sums over all descendants added, for ``junctions`` (``name, up, leaves, saved``)."""
    state = junctions
    while True:
        active = state.filter("up IS NOT NULL")
        gains = stored(active.groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("count")))
        if gains.isEmpty():
            return state.select("name", "leaves", "saved")
        ups = stored(active.select(F.col("name").alias("up"), F.col("up").alias("next")).join(gains.select("up", "count"), "up"))
        farther = with_classes(active.select("name", "up"), ups, ["up"], "count").select("name", F.col("next").alias("up"))
        state = stored(state.drop("up").join(gains.withColumnRenamed("up", "name"), "name", "left").join(farther, "name", "left").select(
            "name", "up", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of one row's conversations, at most ``PIECE`` to a piece; what comes is sorted."""
    key, ids, out = None, [], []
    for batch in batches:
        for row, conv in zip(batch["row"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if ids and (row != key or len(ids) >= PIECE):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = row
            ids.append(conv)
        yield _pieces(out)
        out = []
    yield _pieces([(key, ids[0], ",".join(map(str, ids)))] if ids else [])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    rows, first, ids = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(first, pa.int64()), pa.array(ids, pa.string())], ["row", "first", "ids"])


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each row's joined ids, taken piece by piece."""
    key, state = None, None
    for batch in batches:
        out = []
        for row, ids in zip(batch["row"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if row != key:
                if state:
                    out.append((key, state.hexdigest()))
                key, state = row, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _hashes(out)
    yield _hashes([(key, state.hexdigest())] if state else [])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    rows, digests = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(digests, pa.string())], ["row", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """``row, ends_sha256`` of ``members`` (``row, conv_id``). Ids are dealt by ranges and joined there, so the task that hashes a row gets few, bounded texts."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(members).repartitionByRange(n, "row", "conv_id").sortWithinPartitions("row", "conv_id")
    pieces = stored(ranged.mapInArrow(_id_pieces, "row binary, first long, ids string"))
    return pieces.repartition("row").sortWithinPartitions("row", "first").mapInArrow(_id_hashes, "row binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, limit: int = 128, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the trie of ``turns`` (``conv_id, depth`` from 1 without gaps, ``id, words``); ``convs`` has all ``conv_id`` once, also those without turns.

    ``name`` and ``parent`` name a node and the one above, ``conv_id`` is the smallest of ``n_convs`` members and ``parent_conv_id`` that of the parent,
    ``n_children`` its children, ``n_leaves`` the childless nodes of its subtree, ``saved_tokens`` what prefix sharing spares there, ``ends_sha256``
    the hash of the ids that end at it. The turn at ``depth`` of ``conv_id`` is the node's.
    """
    members = stored(_suffixes(_segments(turns, segment)))
    burst, remaining = _burst(_collapsed(members), limit)
    swept = stored(remaining.withColumn("turn", F.col("turns")[0]["id"]).repartition("head", "turn").sortWithinPartitions("head", "turn", "turns").drop("turn").mapInArrow(_sweep, NODE))

    empty = convs.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select(F.lit(ROOT).alias("row"), "conv_id")
    root = convs.agg(F.min("conv_id").alias("conv"), F.count("*").alias("n")).filter("n > 0").select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv", "n", F.lit(0).cast("long").alias("words"), F.lit(ROOT).alias("row"))
    heads = stored(_union([root, *burst]))
    ends = _ends(members.filter("last").select("row", "conv_id").unionByName(empty))
    return _finished(heads, swept).join(ends, "row", "left").select(
        "name", "parent", F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def _or_zero(*columns: str) -> list[Column]:
    return [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns]


def _finished(heads: DataFrame, swept: DataFrame) -> DataFrame:
    """All nodes with their sums: the root and burst nodes (``heads``), and those of the containers."""
    # what hangs on a junction: containers' highest nodes, and burst nodes
    tops = swept.filter("top")
    hung = tops.groupBy("parent").agg(F.count("*").alias("tops"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = heads.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("bursts"))
    under = stored(hung.join(below, "parent", "full").select(F.col("parent").alias("name"), *_or_zero("tops", "bursts", "leaves", "saved")).select(
        "name", (F.col("tops") + F.col("bursts")).alias("children"), "leaves", "saved"))
    headed = heads.join(under, "name", "left").select("name", "parent", "depth", "conv", "n", "words", "row", *_or_zero("children", "leaves", "saved"))
    headed = stored(headed.withColumns({
        "leaves": F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("words")}))
    # a junction in a container hangs on the container's head
    inner = swept.filter("junction").select("name", F.element_at("above", -1).alias("highest"), "above", "conv")
    inner = stored(inner.join(tops.select(F.col("name").alias("highest"), F.col("parent").alias("up")), "highest").join(under, "name", "left").select(
        "name", "up", "above", "conv", *_or_zero("children", "leaves", "saved")))
    sums = _collected(stored(headed.select("name", F.col("parent").alias("up"), "leaves", "saved").unionByName(inner.select("name", "up", "leaves", "saved"))))

    outer = headed.drop("leaves", "saved").join(sums, "name")
    gains = inner.select("name", "above").join(sums, "name").select(F.explode("above").alias("name"), "leaves", "saved").groupBy("name").agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    grown = stored(swept.join(gains, "name", "left").join(inner.select("name", F.col("children").alias("more")), "name", "left").select(
        "name", "parent", "depth", "conv", "n", "row", "parent_conv", "top", *[
            (F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("children", "more"), ("leaves", "more_leaves"), ("saved", "more_saved"))]))
    # nodes whose parent is a junction learn its smallest member here
    columns = ["name", "parent", "depth", "conv", "n", "children", "leaves", "saved", "row"]
    hanging = stored(grown.filter("top").select(*columns).unionByName(outer.filter("parent IS NOT NULL").select(*columns)))
    junctions = headed.select("name", "conv").unionByName(inner.select("name", "conv")).join(under.select("name", F.col("children").alias("count")), "name")
    parents = stored(junctions.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"), "count"))
    placed = with_classes(hanging, parents, ["parent"], "count")
    columns.insert(4, "parent_conv")
    return _union([grown.filter("NOT top").select(*columns), placed.select(*columns), outer.filter("parent IS NULL").withColumn("parent_conv", F.lit(None).cast("long")).select(*columns)])
