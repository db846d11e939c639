"""SimHash near-duplicates by pigeonring filtering.

A document's fingerprint has a bit set if more than half of the hashes of its word shingles have it set. Equal fingerprints are one
class from the start. Two classes are linked if they differ in at most ``distance`` bits. The 64 bits are cut into
``distance + 1`` segments on a ring. By the pigeonring principle two linked fingerprints have, from some segment on, a chain of consecutive
segments of every length ``l`` in which they differ in at most ``l * distance / (distance + 1)`` bits, so in ``l - 1``.

The chains of length two make the join: a first segment that is equal and a second one that differs in one bit at most. A class stands
under its own two segments, and under those with one set bit of the second one cleared, since of two values that differ in one
bit one becomes the other that way. What meets is held against the budgets of the longer chains, length by length, and what is left against
the whole distance. Within a bucket only the links that connect it are kept, never all pairs. A bucket of more than ``dense``
classes is not compared; its members go on, unheld, to buckets that also share five of the eight pieces of the remaining bits (three bits cannot
touch more than three of them), for every choice of five. That is exact, too, and leaves a few thousand possible members at most.

Defined results: NULL, empty and wordless texts have fingerprint zero, which is linked like any other; equal rows are in one
component; a NULL ``doc_id`` is never the smallest unless there is no other; an empty table gives an empty table;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.common import stored, with_classes
from corpusmill.llm.graph import connected_components
from corpusmill.llm.near_duplicates import _roots
from corpusmill.llm.shingles import mixed

BITS = 64
# Fixed value: the seed of the shingles' hashes.
SEED = 42
BLOCK = 1 << 20
PIECES = 8


def word_blocks(text: bytes, k: int) -> Iterator[list[bytes]]:
    """The words of a text in blocks of about ``BLOCK`` bytes, each with the last ``k - 1`` words of the one before."""
    before: list[bytes] = []
    while text:
        words = text[:BLOCK].split() if len(text) > BLOCK else text.split()
        done = len(text)
        if len(text) > BLOCK:
            head = text[:BLOCK]
            if not text[BLOCK:BLOCK + 1].isspace() and not head[-1:].isspace():
                # the last word goes on: it is the next block's, unless it is all there is
                cut = len(head) - len(words[-1]) if words else BLOCK
                if cut:
                    words, done = words[:-1], cut
                else:
                    rest = text.split(None, 1)
                    words, done = rest[:1], len(text) - (len(rest[1]) if len(rest) > 1 else 0)
            else:
                done = BLOCK
        text = text[done:]
        if words:
            yield before + words
            before = (before + words)[-(k - 1):] if k > 1 else []


def fingerprint(text: bytes, k: int) -> int:
    """64 bits of a text: each is set if more than half of its shingles' hashes have it."""
    ones, n, seen = np.zeros(BITS, np.int64), 0, 0
    short: list[bytes] = []
    hashed = xxhash.xxh64_intdigest
    for words in word_blocks(text.lower(), k):
        if len(words) < k:
            short = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        begins = np.concatenate([[0], ends[:-1]]).tolist()
        found = [hashed(joined[a:b], SEED) for a, b in zip(begins, (ends[k - 1:] - 1).tolist())]
        for at in range(0, len(found), 1 << 16):
            part = np.array(found[at:at + (1 << 16)], np.uint64)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(found)
        seen += 1
    if not n and short:
        return hashed(b" ".join(short), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``doc_id, bits``: one row per row of ``docs``; ``bits`` is the fingerprint as a signed number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", k) for t in batch["text"].cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.array(own, np.uint64).view(np.int64))], ["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bits long")


def segments(distance: int) -> list[np.uint64]:
    """Masks of the ``distance + 1`` segments of the ring, in order."""
    edges = np.linspace(0, BITS, distance + 2).astype(int).tolist()
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def chains(distance: int) -> np.ndarray:
    """``chains[start, length - 1]``: mask of the chain of so many segments from ``start`` on, around the ring."""
    own = segments(distance)
    return np.array([[np.bitwise_or.reduce([own[(s + j) % len(own)] for j in range(n)]) for n in range(1, len(own) + 1)]
                     for s in range(len(own))], np.uint64)


def within_budgets(difference: np.ndarray, start: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which differences keep to the budget of every chain from ``start`` on; the longest chain is the whole ring."""
    held = np.arange(len(difference))
    for n in range(masks.shape[1]):
        held = held[np.bitwise_count(difference[held] & masks[start[held], n]) <= n]
    return held


def _placed(distance: int):
    """Every class under the keys of the two-segment chains it could be met in."""
    masks, own = chains(distance), segments(distance)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch["bits"].to_numpy().view(np.uint64)
            for start in range(len(own)):
                pair = masks[start, min(1, len(own) - 1)]
                second = int(own[(start + 1) % len(own)])
                for bit in [None, *[b for b in range(BITS) if second >> b & 1]]:
                    some = bits if bit is None else bits[bits & np.uint64(1 << bit) != 0]
                    value = some & pair if bit is None else some & pair & ~np.uint64(1 << bit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mixed(mixed(value) + np.uint64(start)).view(np.int64)), pa.array(np.full(len(some), start, np.int32)), pa.array(some.view(np.int64))],
                        ["bucket", "start", "bits"])

    return place


def _connecting(bits: np.ndarray, run: np.ndarray, start: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within each run; ``run`` is sorted."""
    n = len(bits)
    root = np.arange(n)
    longest = int(np.bincount(run).max()) if n else 0
    if longest <= 64:
        near = []
        for k in range(1, longest):
            at = np.flatnonzero(run[k:] == run[:-k])
            at = at[within_budgets(bits[at] ^ bits[at + k], start[at], masks)]
            near.append(np.column_stack([at, at + k]))
        root = _roots(n, np.concatenate(near) if near else np.empty((0, 2), np.int64))
    else:
        for i in range(n - 1):
            end = int(np.searchsorted(run, run[i], "right"))
            apart = np.flatnonzero(root[i + 1:end] != root[i]) + i + 1
            linked = apart[within_budgets(bits[apart] ^ bits[i], start[apart], masks)]
            if len(linked):
                joined = np.unique(np.append(root[linked], root[i]))
                root[np.isin(root, joined)] = joined[0]
    a = np.flatnonzero(root != np.arange(n))
    return bits[a], bits[root[a]]


def _split(bits: np.ndarray, start: int, bucket: int, masks: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Members of a dense bucket under every choice of equal pieces of the remaining bits."""
    free = [b for b in range(BITS) if not int(masks[start, min(1, masks.shape[1] - 1)]) >> b & 1]
    edges = np.linspace(0, len(free), max(PIECES, distance + 1) + 1).astype(int).tolist()
    parts = [sum(1 << b for b in free[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    for number, chosen in enumerate(combinations(parts, len(parts) - distance)):
        value = bits & np.uint64(sum(chosen))
        key = mixed(mixed(np.full(1, bucket, np.int64).view(np.uint64) + np.uint64(number)) ^ mixed(value))
        yield _rows(key, start, bits)


SOLVED = "a long, b long, bucket long, start int, bits long"


def _rows(key: np.ndarray, start: int, bits: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(bits), pa.int64())
    return pa.RecordBatch.from_arrays(
        [none, none, pa.array(key.view(np.int64)), pa.array(np.full(len(bits), start, np.int32)), pa.array(bits.view(np.int64))],
        ["a", "b", "bucket", "start", "bits"])


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, pa.nulls(len(a), pa.int32()), none], ["a", "b", "bucket", "start", "bits"])


def _solved(distance: int, dense: int | None):
    """Connecting links of every bucket; rows come sorted by bucket. Members of buckets over ``dense`` go on as rows."""
    masks = chains(distance)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what is kept of the last run, whose end is not known yet; open: the bucket that is known to be dense
        kept, open_ = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64)), None
        for batch in batches:
            bucket, start, bits = (np.concatenate([x, y]) for x, y in zip(kept, (
                batch["bucket"].to_numpy(), batch["start"].to_numpy(), batch["bits"].to_numpy().view(np.uint64)), strict=True))
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (start[1:] != start[:-1])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if open_ is not None and len(bucket) and (int(bucket[0]), int(start[0])) == open_:
                end = int(cuts[0]) if len(cuts) else len(bucket)
                yield from _split(bits[:end], int(start[0]), open_[0], masks, distance)
                bucket, start, bits, last = bucket[end:], start[end:], bits[end:], max(0, last - end)
            yield from whole(bucket[:last], start[:last], bits[:last])
            kept, open_ = (bucket[last:], start[last:], bits[last:]), open_ if not last and not len(bucket) else None
            if dense is not None and len(kept[0]) > dense:
                open_ = int(kept[0][0]), int(kept[1][0])
                yield from _split(kept[2], open_[1], open_[0], masks, distance)
                kept = tuple(x[:0] for x in kept)
        yield from whole(*kept)

    def whole(bucket: np.ndarray, start: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(bucket):
            return
        run = np.concatenate([[0], np.cumsum((bucket[1:] != bucket[:-1]) | (start[1:] != start[:-1]))])
        sizes = np.bincount(run)[run]
        for some in (sizes > 1) & (sizes <= 64), (sizes > 64) & (sizes <= (dense or len(bucket))):
            at = np.flatnonzero(some)
            if len(at):
                yield _links(*_connecting(bits[at], np.unique(run[at], return_inverse=True)[1], start[at], masks))
        if dense is not None:
            for r in np.unique(run[sizes > dense]).tolist():
                at = np.flatnonzero(run == r)
                yield from _split(bits[at], int(start[at[0]]), int(bucket[at[0]]), masks, distance)

    return solve


def fingerprint_links(classes: DataFrame, distance: int = 3, dense: int = 4096) -> DataFrame:
    """``a, b``: pairs that connect what is within ``distance`` among ``classes`` (``bits``, distinct), directly or over others."""
    placed = classes.select("bits").mapInArrow(_placed(distance), "bucket long, start int, bits long")
    solved = stored(placed.repartition("bucket").sortWithinPartitions("bucket", "start").mapInArrow(_solved(distance, dense), SOLVED))
    rest = solved.filter("bucket IS NOT NULL").select("bucket", "start", "bits")
    again = rest.repartition("bucket").sortWithinPartitions("bucket", "start").mapInArrow(_solved(distance, None), SOLVED)
    return stored(solved.filter("bucket IS NULL").select("a", "b").unionByName(again.select("a", "b")).distinct())


def similar_fingerprints(docs: DataFrame, k: int = 3, distance: int = 3, dense: int = 4096) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``; the fingerprint in hexadecimal digits."""
    rows = stored(fingerprints(docs, k))
    classes = stored(rows.groupBy("bits").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    links = fingerprint_links(classes, distance, dense) if distance else classes.select(F.col("bits").alias("a"), F.col("bits").alias("b")).limit(0)
    labels = connected_components(links).withColumnRenamed("node", "bits")
    rooted = classes.join(labels, "bits", "left").select("bits", "n", "least", F.coalesce("root", "bits").alias("root"))
    named = stored(rooted)
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    grouped = stored(with_classes(named, stored(firsts), ["root"], "members").select("bits", "n", "component_id"))
    return with_classes(rows, grouped, ["bits"], "n").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
