"""MinHash near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles; documents with equal sets are one class from the start. Every class has a signature of
``COORDINATES`` minwise tokens. In each of ``trees`` independent trees a class walks to a child node named by a
chosen coordinate and its token there. Nodes of at most ``small`` classes are compared exhaustively by signature.
A larger node compares everything with one pivot and branches again: classes near the pivot are one candidate group,
and of those only the ones on the rim, which could still be near something that is far from the pivot, walk on with the rest
(Jaccard distance obeys the triangle inequality). A node where everything is near the pivot is done; the pivot itself never walks on,
so every node comes to an end.

What this yields are candidate groups, wider than needed. Links are then confirmed on full sets: a group that fits a
task is solved there; in a larger one, the most central member and then all that are not linked to it are pivots, shown to
all members in batches of ``max_pivot_bytes``. Only the pivots of one batch pass through the driver.

Defined results: NULL, empty and wordless texts have an empty set and are linked with nothing; equal rows are in one
component; a NULL ``doc_id`` is never the smallest unless there is no other; an empty table gives an empty table;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.llm.common import free_name, keep_rows, stored, text_key
from corpusmill.llm.graph import connected_components
from corpusmill.llm.shingles import mixed, shingle_sets

COORDINATES = 64
# Signature agreement at which classes are candidates, far enough below the wanted similarity for no link to be missed,
# agreement with a pivot that joins its group, and by how much more a class must agree with the pivot than another one
# so that the two cannot be similar (0.25 by the triangle inequality, the rest for chance).
CANDIDATE, GROUP, RIM = 0.45, 0.3, 0.38
# Signature agreement below which a pair need not be confirmed on full sets: 3.7 standard deviations from 0.75.
CONFIRM = 0.55
BRANCHES = 2
_FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADDENDS = mixed(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))
SALTS = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def signature(tokens: np.ndarray) -> np.ndarray:
    """Smallest hash of the tokens under each of the coordinates' hash functions."""
    low = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(tokens), 4096):
        block = (tokens[at:at + 4096, None] * _FACTORS + _ADDENDS) >> np.uint64(32)
        low = np.minimum(low, block.min(axis=0).astype(np.uint32))
    return low


def signed(docs: DataFrame, k: int = 5) -> DataFrame:
    """``__id, __text, n_shingles, first, second, signature``: one row per row of ``docs``.

    ``first`` and ``second`` are 128 bits that name the set.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, signatures = [], [[], []], []
            for tokens in shingle_sets(batch["text"], k):
                sizes.append(len(tokens))
                for name, salt in zip(names, SALTS, strict=True):
                    name.append(int(mixed(tokens ^ salt).sum(dtype=np.uint64).astype(np.int64)))
                signatures.append(signature(tokens).tobytes() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["__id"], batch["__text"], pa.array(sizes, pa.int64()), *[pa.array(n, pa.int64()) for n in names], pa.array(signatures, pa.binary())],
                ["__id", "__text", "n_shingles", "first", "second", "signature"])

    narrow = docs.select(F.col("doc_id").alias("__id"), text_key(F.col("text")).alias("__text"), "text")
    kind = narrow.schema["__id"].dataType.simpleString()
    return narrow.mapInArrow(sign, f"__id {kind}, __text long, n_shingles long, first long, second long, signature binary")


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal key together; batches come sorted by it."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch[key].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if kept and len(keys) and keys[0] != kept[0][key][0].as_py():
            yield pa.Table.from_batches(kept)
            kept = []
        edges = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs, for each of ``n`` nodes."""
    root = np.arange(n)
    while len(pairs):
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        pairs, a, b = pairs[a != b], a[a != b], b[a != b]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _within_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches, "node"):
        table = table.combine_chunks()
        reps = table["rep"].to_numpy()
        sigs = _matrix(table["signature"], np.uint32, COORDINATES)
        near = [(i, j) for i in range(len(reps) - 1) for j in np.flatnonzero((sigs[i + 1:] == sigs[i]).mean(axis=1) >= CANDIDATE) + i + 1]
        root = _roots(len(reps), np.array(near).reshape(-1, 2))
        a = np.flatnonzero(root != np.arange(len(reps)))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(reps[a]), pa.array(reps[root[a]])], ["a", "b"])


def _within_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Agreement of members with their pivot, and the ``BRANCHES`` child nodes they would walk on to."""
    for batch in batches:
        sigs = _matrix(batch["signature"], np.uint32, COORDINATES)
        alike = (sigs == _matrix(batch["pivot_signature"], np.uint32, COORDINATES)).mean(axis=1)
        node = batch["node"].to_numpy().astype(np.uint64)
        children = []
        for k in range(BRANCHES):
            chosen = mixed(node + np.uint64(k + 1))
            token = sigs[np.arange(len(sigs)), (chosen % np.uint64(COORDINATES)).astype(int)]
            children.append(mixed(chosen ^ mixed(token.astype(np.uint64) + np.uint64(1))).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch["node"], batch["rep"], batch["pivot"], pa.array(alike, pa.float64()), pa.array(np.column_stack(children).tolist(), pa.list_(pa.int64()))],
            ["node", "rep", "pivot", "alike", "children"])


def candidate_groups(classes: DataFrame, trees: int = 8, small: int = 4096) -> DataFrame:
    """``node, root``: candidate groups of ``classes`` (``rep, signature``), named by their smallest ``rep``."""
    tokens = F.array(*[F.expr(f"substring(signature, {4 * t * (COORDINATES // trees) + 1}, 4)") for t in range(trees)])
    walkers = stored(classes.select("rep", F.posexplode(tokens).alias("tree", "token")).select("rep", F.xxhash64("tree", "token").alias("node")))
    signatures = classes.select("rep", "signature")
    found, solvable = [], []
    while True:
        sizes = stored(walkers.groupBy("node").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep", "node")).alias("pivot")).filter("n > 1"))
        solvable.append(walkers.join(sizes.filter(F.col("n") <= small), "node").select("node", "rep"))
        large = sizes.filter(F.col("n") > small)
        if large.isEmpty():
            break
        pivots = large.select("node", "pivot").join(
            signatures.select(F.col("rep").alias("pivot"), F.col("signature").alias("pivot_signature")), "pivot").select("node", "pivot", "pivot_signature")
        shown = walkers.join(pivots, "node").join(signatures, "rep").select("node", "rep", "pivot", "signature", "pivot_signature")
        walked = stored(shown.mapInArrow(_within_large, "node long, rep long, pivot long, alike double, children array<long>"))
        found.append(walked.filter((F.col("alike") >= GROUP) & (F.col("rep") != F.col("pivot"))).select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        # a node in which all are near the pivot is done; else what could be near the ones that are not walks on with them
        far = walked.filter(F.col("alike") < GROUP).groupBy("node").agg(F.max("alike").alias("rim"))
        on = walked.join(far, "node").filter((F.col("rep") != F.col("pivot")) & (F.col("alike") < F.col("rim") + RIM))
        walkers = stored(on.select("rep", F.explode("children").alias("node")).distinct())
    few = _union(solvable).join(signatures, "rep")
    found.append(few.repartition("node").sortWithinPartitions("node").mapInArrow(_within_small, "a long, b long"))
    return connected_components(_union(found))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """``100 * |a and b| >= percent * |a or b|``."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _solve_group(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Components of the links between sets: first around the most central ones, then likely pairs, and no pair that is already connected."""
    sigs = np.array([signature(s) for s in sets])
    root = np.arange(len(sets))

    def merge(i: int, others: np.ndarray) -> None:
        for j in others:
            a, b = root[i], root[j]
            if a != b and _jaccard_at_least(sets[i], sets[j], percent):
                root[root == max(a, b)] = min(a, b)

    if len(sets) > 8:
        usual = np.array([np.unique(column, return_counts=True) for column in sigs.T], dtype=object)
        mode = np.array([tokens[np.argmax(counts)] for tokens, counts in usual])
        for i in np.argsort(-(sigs == mode).sum(axis=1), kind="stable")[:8]:
            merge(i, np.flatnonzero((sigs == sigs[i]).mean(axis=1) >= CONFIRM))
    for strong in (True, False):
        for i in range(len(sets) - 1):
            apart = np.flatnonzero(root[i + 1:] != root[i]) + i + 1
            if len(apart):
                alike = (sigs[apart] == sigs[i]).mean(axis=1)
                merge(i, apart[(alike >= 0.7) if strong else (alike >= CONFIRM) & (alike < 0.7)])
    return root


def _small_links(k: int, percent: int):
    """Links within groups, whose rows come one after the other. Shingles are made of many texts at once, as most groups are a few short lines."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, reps, sets = None, [], []
        a: list[int] = []
        b: list[int] = []

        def solved() -> None:
            root = _solve_group(sets, percent)
            for i in np.flatnonzero(root != np.arange(len(sets))).tolist():
                a.append(reps[i])
                b.append(reps[root[i]])

        def links() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for root, rep, own in zip(batch["root"].to_pylist(), batch["rep"].to_pylist(), shingle_sets(batch["text"], k), strict=True):
                if root != group and sets:
                    solved()
                    reps, sets = [], []
                group = root
                reps.append(rep)
                sets.append(own)
            if a:
                yield links()
                a, b = [], []
        if sets:
            solved()
        if a:
            yield links()

    return solve


def _central(members: DataFrame) -> DataFrame:
    """``rep``: of every group the member whose signature agrees best with its most frequent token in each coordinate."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _matrix(batch["signature"], np.uint32, COORDINATES)
            n = len(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch["root"].to_numpy(), COORDINATES)), pa.array(np.tile(np.arange(COORDINATES), n)), pa.array(tokens.ravel().astype(np.int64)),
                 pa.array(np.repeat(batch["rep"].to_numpy(), COORDINATES))], ["root", "at", "token", "rep"])

    tokens = members.select("root", "rep", "signature").mapInArrow(spread, "root long, at long, token long, rep long")
    counts = tokens.groupBy("root", "at", "token").agg(F.count("*").alias("n"))
    mode = (counts.groupBy("root", "at").agg(F.max_by("token", F.struct("n", "token")).alias("token")).groupBy("root").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("mode")))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch["signature"], np.uint32, COORDINATES)
            mode = np.array(batch["mode"].to_pylist(), np.int64).reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays([batch["root"], batch["rep"], pa.array((own == mode).sum(axis=1))], ["root", "rep", "agree"])

    rated = members.select("root", "rep", "signature").join(mode, "root").select("root", "rep", "signature", "mode").mapInArrow(
        agree, "root long, rep long, agree long")
    best = rated.groupBy("root").agg(F.max_by("rep", F.struct("agree", "rep")).alias("rep"))
    return stored(best.select("rep"))


def _pivot_links(members: DataFrame, batch: DataFrame, percent: int) -> DataFrame:
    """``a, b``: members and the pivots of their group (``rep`` in ``batch``) they are linked to, as far as these are not connected yet."""
    spark = members.sparkSession
    shown: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for p in members.join(F.broadcast(batch), "rep").select("root", "rep", "tokens", "signature").collect():
        shown.setdefault(p["root"], []).append((p["rep"], bytes(p["tokens"]), bytes(p["signature"])))
    shipped = spark.sparkContext.broadcast(shown)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {
            root: (np.array([r for r, _, _ in ps]), [np.frombuffer(t, np.uint64) for _, t, _ in ps],
                   np.array([np.frombuffer(s, np.uint32) for _, _, s in ps]), np.arange(len(ps)))
            for root, ps in shipped.value.items()
        }
        for rows in batches:
            a, b = [], []
            for root, rep, sig, tokens in zip(*(rows[c].to_pylist() for c in ("root", "rep", "signature", "tokens")), strict=True):
                if root not in table:
                    continue
                # joined: which pivots this task has found to be connected; one link to each of those is enough
                reps, sets, sigs, joined = table[root]
                own, linked = np.frombuffer(tokens, np.uint64), set()
                alike = (sigs == np.frombuffer(sig, np.uint32)).mean(axis=1)
                likely = np.flatnonzero(alike >= CONFIRM)
                for at in likely[np.argsort(-alike[likely])]:
                    if joined[at] not in linked and (reps[at] == rep or _jaccard_at_least(own, sets[at], percent)):
                        linked.add(joined[at])
                        a.append(rep)
                        b.append(int(reps[at]))
                if len(linked) > 1:
                    joined[np.isin(joined, list(linked))] = min(linked)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = stored(members.select("root", "rep", "signature", "tokens").mapInArrow(compare, "a long, b long"))
    shipped.unpersist()
    return links


def _large_links(members: DataFrame, max_pivot_bytes: int, percent: int) -> DataFrame:
    """Links of groups that no single task should hold; ``members`` (``root, rep, n_shingles, signature, tokens``) is stored.

    First every member is compared with the most central one. Those linked to it are in one component, and pairs among
    them need no look; each of the others becomes a pivot, too, and meets all members.
    """
    central = _central(members)
    near = _by_batches(members, central, max_pivot_bytes, percent)
    covered = near.select(F.col("a").alias("rep")).unionByName(central).distinct()
    others = members.select("rep").join(covered, "rep", "left_anti")
    return near.unionByName(_by_batches(members, others, max_pivot_bytes, percent))


def _by_batches(members: DataFrame, pivots: DataFrame, max_pivot_bytes: int, percent: int) -> DataFrame:
    """:func:`_pivot_links` of all ``pivots`` (``rep``), of which the driver sees ``max_pivot_bytes`` at a time."""
    waiting = stored(members.join(pivots, "rep", "left_semi").select(
        "rep", (F.col("n_shingles") * 8 + 512).alias("bytes"), F.xxhash64("rep").alias("turn")))
    found, last = [], None
    while True:
        after = waiting if last is None else waiting.filter(F.col("turn") > last)
        some = after.orderBy("turn").limit(max(1, max_pivot_bytes // 520))
        upto = F.coalesce(F.sum("bytes").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        batch = stored(some.withColumn("upto", upto).filter(F.col("upto") < max_pivot_bytes).select("rep", "turn"))
        last = batch.agg(F.max("turn")).first()[0]
        if last is None:
            return _union(found) if found else members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
        found.append(_pivot_links(members, batch.select("rep"), percent))


def _tokens_of(k: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch["text"], k))
            yield pa.RecordBatch.from_arrays(
                [batch["root"], batch["rep"], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["root", "rep", "n_shingles", "signature", "tokens"])

    return pack


def confirmed_links(
    located: DataFrame, k: int = 5, percent: int = 75, task_classes: int = 1000, task_bytes: int = 8_000_000, max_pivot_bytes: int = 32_000_000,
) -> DataFrame:
    """``a, b``: links that connect, within each candidate group of ``located`` (``root, rep, text``), what full sets link."""
    sizes = located.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("s"))
    fits = (F.col("n") <= task_classes) & (F.col("s") <= task_bytes)
    placed = stored(located.join(sizes.select("root", fits.alias("fits")), "root"))
    solved = stored(placed.filter("fits").select("root", "rep", "text").repartition("root").sortWithinPartitions("root").mapInArrow(
        _small_links(k, percent), "a long, b long"))
    large = placed.filter(~F.col("fits"))
    if large.isEmpty():
        return solved
    packed = large.select("root", "rep", "text").mapInArrow(
        _tokens_of(k), "root long, rep long, n_shingles long, signature binary, tokens binary")
    return solved.unionByName(_large_links(stored(packed), max_pivot_bytes, percent))


def components(
    docs: DataFrame, k: int = 5, percent: int = 75, trees: int = 8, small: int = 4096, **group_options: int,
) -> DataFrame:
    """``__id, __text, n_shingles, component_id, keeper``: one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` of the component and ``keeper`` its smallest (``doc_id``, text) of all.
    """
    rows = stored(signed(docs, k))
    # a class is named by one of its rows, as a 64-bit hash of the set
    rep = F.xxhash64("first", "second", "n_shingles")
    classes = rows.filter("n_shingles > 0").groupBy(rep.alias("rep")).agg(
        F.min_by(F.struct("__id", "__text", "n_shingles", "signature"), F.struct(F.col("__id").isNull(), "__id", "__text")).alias("r"))
    classes = stored(classes.select("rep", "r.*"))
    groups = candidate_groups(classes.select("rep", "signature"), trees=trees, small=small)
    grouped = classes.select("rep", "__id", "__text").join(groups.withColumnRenamed("node", "rep"), "rep")
    texts = docs.select(F.col("doc_id").alias("i"), text_key(F.col("text")).alias("t"), "text")
    located = grouped.join(texts, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__text") == F.col("t"))).dropDuplicates(["rep"])
    links = confirmed_links(located.select("root", "rep", "text"), k, percent, **group_options)
    labels = connected_components(links).withColumnRenamed("node", "rep").withColumnRenamed("root", "label")
    key = F.struct(F.col("__id").isNull().alias("none"), "__id", "__text")
    firsts = classes.select("rep", key.alias("key")).join(labels, "rep", "left").groupBy(F.coalesce("label", "rep").alias("label")).agg(F.min("key").alias("key"))
    named = classes.select("rep").join(labels, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")).join(firsts, "label")
    joined = rows.withColumn("rep", F.when(F.col("n_shingles") > 0, rep)).join(named.select("rep", F.col("key").alias("found")), "rep", "left")
    keeper = F.coalesce("found", key)
    return joined.select("__id", "__text", "n_shingles", keeper["__id"].alias("component_id"), keeper.alias("keeper"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``."""
    return components(docs, **options).select(
        F.col("__id").alias("doc_id"), "n_shingles", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of every component, columns as they are."""
    found = components(docs, **options)
    kept = found.filter((F.col("__id").eqNullSafe(F.col("keeper")["__id"])) & (F.col("__text") == F.col("keeper")["__text"]))
    counted = stored(kept.groupBy("__id", "__text").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size")))
    once = keep_rows(docs, counted.filter("n = 1 OR size = 0").select("__id", "__text"))
    repeated = counted.filter("n > 1 AND size > 0").select("__id", "__text")
    if repeated.isEmpty():
        return once
    name = free_name(docs, "__key")
    first = keep_rows(docs, repeated).withColumn(name, F.struct(F.col("doc_id"), text_key(F.col("text")))).dropDuplicates([name])
    return once.unionByName(first.drop(name))
