"""Removal of repeated passages with a suffix array over chosen positions.

A byte is removed when a string of ``length`` bytes that covers it also starts anywhere else. Instead of all suffixes only
those at anchors are sorted: the anchor of a window of ``length`` bytes is the place of the smallest hash of ``gram`` bytes
in it, the leftmost of equals. It depends on nothing but the window's bytes, so equal windows have their anchors at the same place, and
some 70 windows share one. Anchors whose gram occurs once are out after one count.

The suffixes of the rest (from the anchor to the end of its last window) are sorted by a distributed merge sort that knows
common prefixes. Tasks sort runs and front-code them: every suffix is sent as the length of the prefix it shares with the one before
and what follows. Ranges of grams, cut at sampled splitters, are merged by loser trees which remember for every loser how much it
shares with the last winner; shared prefixes are never compared again, and only equal lengths need a look at bytes at all. In merged
order suffixes that share a gram are neighbours; within these, windows are compared at equal distance from their anchor.

A gram with more than ``hot`` anchors would be too much for a task. Its windows are compared as 128-bit hashes in an ordinary
aggregation, of which the counts are made where the texts are.

Defined results: a NULL text is an empty one, and nothing is removed of texts shorter than ``length``; equal rows repeat
each other; matches never cross documents; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.common import stored, text_key
from corpusmill.llm.shingles import inverse, mixed, pieces, powers, string_bytes

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
SAMPLE = 256
_PLACE = np.uint64((1 << 31) - 1)


def window_hashes(raw: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of the ``n`` bytes from every place that has as many behind it."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(base, len(raw)), out=total[1:])
    if len(raw) < n:
        return total[:0]
    return mixed((total[n:] - total[:-n]) * powers(inverse(base), len(raw) - n + 1))


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every ``n`` consecutive values."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = n - width
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``value, place, before, after, hash``: every anchor, with the distance to its first and last window's start."""
    empty = np.empty(0, np.int64)
    if len(raw) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64)
    hashes = window_hashes(raw, gram)
    keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (sliding_least(keys, length - gram + 1) & _PLACE).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int32)
    whole = np.diff(bounds) >= length
    np.add.at(inside, bounds[:-1][whole], 1)
    np.add.at(inside, bounds[1:][whole] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[:len(chosen)] > 0)
    if not len(starts):
        return empty, empty, empty, empty, empty.astype(np.uint64)
    at = chosen[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    place = at[first]
    value = np.searchsorted(bounds, place, "right") - 1
    return value, place - bounds[value], place - starts[first], place - starts[last], hashes[place]


def find_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``hash, row, at, gram``: ``at`` is the place and both distances in one number; one hash in ``SAMPLE`` shows its gram."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["row"].to_numpy()
            raw, bounds = string_bytes(batch["text"])
            for a, b in pieces(bounds):
                own = bounds[a:b + 1]
                value, place, before, after, hashes = anchors(raw[own[0]:own[-1]], own - own[0], length, gram)
                grams: list[bytes | None] = [None] * len(place)
                for i in np.flatnonzero(hashes % np.uint64(SAMPLE) == 0).tolist():
                    begin = own[value[i]] + place[i]
                    grams[i] = raw[begin:begin + gram].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.astype(np.int64)), pa.array(rows[a + value]), pa.array(place << 20 | before << 10 | after), pa.array(grams, pa.binary())],
                    ["hash", "row", "at", "gram"])

    return docs.select("row", "text").mapInArrow(find, "hash long, row long, at long, gram binary")


def _cut(at: int) -> tuple[int, int, int]:
    return at >> 20, at >> 10 & 1023, at & 1023


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n if not x else n - 1 - (x.bit_length() - 1) // 8


def make_runs(length: int, splitters: list[bytes], most: int):
    """Sorted, front-coded runs, one row for every range of grams that a run reaches."""

    def flush(found: list[tuple[bytes, bytes, int, int]], run: int) -> Iterator[pa.RecordBatch]:
        found.sort(key=lambda x: x[0])
        parts = [bisect_right(splitters, s[0]) for s in found]
        pack = zstandard.ZstdCompressor(level=1)
        first = 0
        while first < len(found):
            end = bisect_right(parts, parts[first])
            shared, rests, before = [], [], b""
            for suffix, *_ in found[first:end]:
                n = _shared(before, suffix, 0)
                shared.append(n)
                rests.append(suffix[n:])
                before = suffix
            own = found[first:end]
            yield pa.RecordBatch.from_arrays([
                pa.array([parts[first]], pa.int32()), pa.array([run], pa.int64()),
                *[pa.array([pack.compress(x)], pa.binary()) for x in (
                    np.array(shared, np.uint16).tobytes(), np.array([len(r) for r in rests], np.uint16).tobytes(), b"".join(rests),
                    np.array([len(s[1]) for s in own], np.uint16).tobytes(), b"".join(s[1] for s in own),
                    np.array([s[2:] for s in own], np.int64).tobytes())],
            ], ["part", "run", *RUN])
            first = end

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, run = [], (TaskContext.get().partitionId()) << 24
        for batch in batches:
            for row, text, places in zip(batch["row"].to_pylist(), batch["text"], batch["places"].to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for at in places:
                    place, before, after = _cut(at)
                    found.append((raw[place:place - after + length], raw[place - before:place], row, place))
                if len(found) >= most:
                    yield from flush(found, run)
                    found, run = [], run + 1
        if found:
            yield from flush(found, run)

    return runs


RUN = ("shared", "rest_lengths", "rests", "left_lengths", "lefts", "ids")
_RUN_TYPE = "part int, run long, " + ", ".join(f"{c} binary" for c in RUN)


class Run:
    """A front-coded run, read suffix by suffix."""

    def __init__(self, columns: list[bytes]):
        unpack = zstandard.ZstdDecompressor()
        shared, lengths, self.rests, left_lengths, self.lefts, ids = (unpack.decompress(c) for c in columns)
        self.shared = np.frombuffer(shared, np.uint16).tolist()
        self.rest_at = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.uint16), dtype=np.int64)]).tolist()
        self.left_at = np.concatenate([[0], np.cumsum(np.frombuffer(left_lengths, np.uint16), dtype=np.int64)]).tolist()
        self.ids = np.frombuffer(ids, np.int64).reshape(-1, 2)
        self.at, self.suffix = -1, b""

    def next(self) -> int:
        """Steps to the next suffix; what it shares with the one before, or -1 at the end."""
        self.at += 1
        if self.at == len(self.shared):
            return -1
        n = self.shared[self.at]
        self.suffix = self.suffix[:n] + self.rests[self.rest_at[self.at]:self.rest_at[self.at + 1]]
        return n

    def left(self) -> bytes:
        return self.lefts[self.left_at[self.at]:self.left_at[self.at + 1]]


def merge(runs: list[Run]) -> Iterator[tuple[Run, int]]:
    """Runs in merged order: the run whose suffix is next, and what that shares with the last one given out.

    ``tree`` holds at every inner node the loser of its match, ``known`` what each run's suffix shares with the last winner.
    A longer known prefix wins without a look at bytes; among equal ones the comparison begins behind the prefix.
    """
    k = 1
    while k < len(runs):
        k *= 2
    known = [r.next() for r in runs] + [-1] * (k - len(runs))
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes what it shares with the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)  # an ended run has -1 and loses
        if known[a] < 0:
            return a, b
        n = known[a]
        x, y = runs[a].suffix, runs[b].suffix
        common = _shared(x, y, n)
        winner, loser = (a, b) if x[common:common + 1] <= y[common:common + 1] else (b, a)
        known[loser] = common
        return winner, loser

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    for i in range(len(runs)):
        known[i] = min(known[i], 0)
    top = build(1) if k > 1 else 0
    while known[top] >= 0:
        yield runs[top], known[top]
        known[top] = runs[top].next()
        node = (top + k) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2


def repeated_windows(found: list[tuple[int, bytes, int]], length: int) -> list[np.ndarray | None]:
    """For every ``(group, bytes around the anchor, anchor's place in them)``: which of its windows another one of
    its group equals; None: all of them."""
    different: dict[tuple[int, bytes, int], list[int]] = {}
    for i, key in enumerate(found):
        different.setdefault(key, []).append(i)
    out: list[np.ndarray | None] = [None] * len(found)
    members = {}
    for group, _, _ in different:
        members[group] = members.get(group, 0) + 1
    asked = [key for key, own in different.items() if members[key[0]] > 1]
    if asked:
        raw = np.frombuffer(b"".join(c for _, c, _ in asked), np.uint8)
        sizes = np.array([len(c) for _, c, _ in asked])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        counts = sizes - length + 1
        ends = np.cumsum(counts)
        start = np.arange(ends[-1]) + np.repeat(bounds[:-1] - (ends - counts), counts)
        distance = np.repeat(bounds[:-1] + np.array([p for _, _, p in asked]), counts) - start
        group = np.repeat(np.array([g for g, _, _ in asked]), counts)
        keys = mixed(window_hashes(raw, length)[start] ^ mixed((group * 1024 + distance).astype(np.uint64)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        flags = np.zeros(len(keys), bool)
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
        for key, end, n in zip(asked, ends.tolist(), counts.tolist(), strict=True):
            if len(different[key]) == 1:
                out[different[key][0]] = flags[end - n:end]
    for key, own in different.items():
        if len(own) == 1 and members[key[0]] == 1:
            out[own[0]] = np.zeros(len(key[1]) - length + 1, bool)
    return out


def merge_runs(length: int, gram: int, batch_size: int = 20_000):
    """``row, begin, end`` of repeated bytes, from all runs of a range of grams."""

    def solve(found: list, ids: list) -> pa.RecordBatch:
        rows, begins, ends = [], [], []
        for (_, around, left), (row, place), flags in zip(found, ids, repeated_windows(found, length), strict=True):
            base = place - left
            if flags is None:
                edges = [0, len(around) - length + 1]
            else:
                edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).tolist()
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                rows.append(row)
                begins.append(base + a)
                ends.append(base + b - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["row", "begin", "end"])

    def merged(runs: list[Run]) -> Iterator[pa.RecordBatch]:
        found, ids, group = [], [], 0
        for run, known in merge(runs):
            if known < gram:
                group += 1
                if len(found) >= batch_size:
                    yield solve(found, ids)
                    found, ids = [], []
            left = run.left()
            found.append((group, left + run.suffix, len(left)))
            ids.append(tuple(run.ids[run.at].tolist()))
        if found:
            yield solve(found, ids)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = None, []
        for batch in batches:
            for p, *columns in zip(*(batch[c].to_pylist() for c in ("part", *RUN)), strict=True):
                if p != part and runs:
                    yield from merged(runs)
                    runs = []
                part = p
                runs.append(Run(columns))
        if runs:
            yield from merged(runs)

    return ranges


def _hot_windows(length: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, places in zip(batch["row"].to_pylist(), batch["text"], batch["places"].to_pylist(), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                for at in places:
                    place, before, after = _cut(at)
                    own = raw[place - before:place - after + length]
                    one, two = (window_hashes(own, length, base).astype(np.int64) for base in (_BASE, _OTHER))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one), pa.array(two), pa.array(np.full(len(one), row)), pa.array(np.arange(len(one)) + place - before)],
                        ["one", "two", "row", "begin"])

    return hashes


def repeats(docs: DataFrame, length: int = 200, gram: int = 64, hot: int = 20_000, run_size: int = 50_000, part_size: int = 100_000) -> DataFrame:
    """``row, begin, end``: stretches of repeated bytes of ``docs`` (``row, text`` and what else is to go with them),
    possibly overlapping."""
    spark = docs.sparkSession
    every = stored(find_anchors(docs, length, gram))
    counts = stored(every.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"))
    again = stored(every.join(counts, "hash").select("row", "at", "n", "hash", "gram"))
    total = again.filter(F.col("n") <= hot).count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // part_size + 1)
    by_row = again.groupBy("row", (F.col("n") > hot).alias("hot")).agg(F.collect_set("at").alias("places"))
    # the same exchange of texts serves both kinds and, in without_repeats, the result
    placed = docs.join(by_row, "row")
    usual = placed.filter("NOT hot").drop("hot")

    # splitters: grams chosen by hash, about 64 for every range
    step = max(1, total // (64 * parts * SAMPLE)) * SAMPLE
    grams = again.filter((F.col("n") <= hot) & F.col("gram").isNotNull() & (F.pmod("hash", F.lit(step)) == 0)).select("gram")
    ranks = sorted(bytes(r["gram"]) for r in grams.limit(200 * parts).collect())
    splitters = sorted({ranks[i * len(ranks) // parts] for i in range(1, parts)}) if ranks else []
    runs = usual.mapInArrow(make_runs(length, splitters, run_size), _RUN_TYPE)
    found = runs.repartition(parts, "part").sortWithinPartitions("part", "run").mapInArrow(merge_runs(length, gram), "row long, begin long, end long")
    if again.filter(F.col("n") > hot).isEmpty():
        return found
    windows = placed.filter("hot").drop("hot").mapInArrow(_hot_windows(length), "one long, two long, row long, begin long")
    twice = windows.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1")
    more = windows.join(twice, ["one", "two"]).select("row", "begin", (F.col("begin") + length).alias("end"))
    return found.unionByName(more)


def _removed(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the stretches cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begins, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``: one row per row of ``docs``; ``kept`` are the remaining bytes."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", text_key(F.col("text"))).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeats(rows, **options).groupBy("row").agg(
        F.collect_set(F.struct("begin", "end")).alias("s")).select("row", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, begins, ends in zip(batch["text"], batch["begins"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                raw, spans = text.as_buffer().to_pybytes(), _removed(begins or [], ends or [])
                edges = [0, *[x for s in spans for x in s], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(found, "row", "left").select("doc_id", "text", "begins", "ends")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
