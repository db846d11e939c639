"""URL rules in a sorted digest array.

Rules are (host, path) prefixes. Their 64-bit xxhash keys are sorted into one array, which every worker maps into
memory; the keys of all places a URL could be listed under (each parent domain with each path prefix of a length
that some rule has) are probed by one vectorised binary search per batch, and every hit is confirmed against the
stored rule, so a digest collision cannot decide a URL.

Defined results: a NULL URL, an empty one and one without ``://`` have an empty host and path and match no
rule; equal rows are judged alike; an empty table gives an empty table. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

# The rules of the query, as (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

RESULT = "page_id long, host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def digest(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Rules sorted by digest: keys to search, and at the same places the stored rules and their verdicts.

    Everything is in one block of bytes: keys, ends of the rules, verdicts, rules. Where an array arrives it is written to a file
    without a name and mapped read-only. A broadcast one arrives once per worker process, whatever the number of its tasks.
    """

    def __init__(self, rules: Sequence[tuple[str, str]]):
        listed = sorted({rule: verdict for verdict, rule in rules}.items())
        keys = np.fromiter((digest(rule) for rule, _ in listed), dtype=np.uint64, count=len(listed))
        order = np.argsort(keys, kind="stable")
        stored = [listed[k][0].encode("utf-8", "surrogatepass") for k in order.tolist()]
        self.names = sorted({verdict for _, verdict in listed})
        numbers = {name: k for k, name in enumerate(self.names)}
        self.n = len(listed)
        self.lengths = sorted({len(r) - r.index("/") for r, _ in listed})
        self.hosts = {r[: r.index("/")].count(".") + 1 for r, _ in listed}
        ends = np.cumsum([0, *map(len, stored)], dtype=np.int64)
        verdicts = np.array([numbers[listed[k][1]] for k in order.tolist()], dtype=np.int32)
        self._map(b"".join([keys[order].tobytes(), ends.tobytes(), verdicts.tobytes(), *stored]))

    def _map(self, block: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.block = np.memmap(f, dtype=np.uint8, mode="r")
        n = self.n
        self.keys = self.block[:8 * n].view(np.uint64)
        self.ends = self.block[8 * n:16 * n + 8].view(np.int64)
        self.verdicts = self.block[16 * n + 8:20 * n + 8].view(np.int32)
        self.text = self.block[20 * n + 8:]

    def packed(self) -> dict:
        """All of it in plain values, which a broadcast can carry to executors that do not have this package."""
        return {"n": self.n, "names": self.names, "lengths": self.lengths, "hosts": self.hosts, "block": self.block.tobytes()}

    @classmethod
    def arrived(cls, packed: dict) -> DigestArray:
        """The array of a broadcast value: the first task of a worker process maps it and leaves it there for the next ones."""
        if "array" not in packed:
            array, block = cls.__new__(cls), packed.pop("block")
            array.__dict__.update(packed)
            array._map(block)
            packed["array"] = array
        return packed["array"]

    def rule(self, at: int) -> str:
        return self.text[self.ends[at]:self.ends[at + 1]].tobytes().decode("utf-8", "surrogatepass")

    def verdict(self, at: int) -> str:
        return self.names[self.verdicts[at]]

    def candidates(self, host: str, path: str) -> list[str]:
        """What could be listed for a URL, longest first; of equal lengths the longer host first."""
        labels = host.split(".")
        hosts = [".".join(labels[-n:]) for n in self.hosts if n <= len(labels)]
        found = [(h, path[:n]) for h in hosts for n in self.lengths if n <= len(path) and path[0] == "/"]
        return [h + p for h, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]

    def look_up(self, parts: Sequence[tuple[str, str]]) -> list[int]:
        """Place of the longest rule that fits each (host, path), or -1."""
        asked = [self.candidates(*p) for p in parts]
        flat = [c for cs in asked for c in cs]
        url = np.repeat(np.arange(len(parts)), [len(cs) for cs in asked])
        probe = np.fromiter((digest(c) for c in flat), dtype=np.uint64, count=len(flat))
        low = np.searchsorted(self.keys, probe, "left")
        high = np.searchsorted(self.keys, probe, "right")
        out = [-1] * len(parts)
        for k in np.flatnonzero(high > low)[::-1]:  # the longest is written last
            for at in range(low[k], high[k]):
                if self.rule(at) == flat[k]:
                    out[url[k]] = at
        return out


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", max_rules: int = 5_000_000) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    An array is built once, on the driver, and every worker maps one of at most ``max_rules`` rules. A longer list is cut into several arrays that
    are probed one after the other, each handing on the longest rule found so far.
    """
    chosen = pages.select("page_id", "url")
    chosen = chosen.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(null as string) rule", "cast(null as string) verdict")
    for begin in range(0, len(rules), max_rules):
        chosen = _probe(chosen, list(rules[begin:begin + max_rules]))
    return _probe(chosen, [], default)


def _probe(pages: DataFrame, rules: list[tuple[str, str]], default: str | None = None) -> DataFrame:
    """With ``default``, the last step: host and path in place of the URL."""
    shipped = pages.sparkSession.sparkContext.broadcast(DigestArray(rules).packed())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = DigestArray.arrived(shipped.value)
        for batch in batches:
            parts = [split_url(u) for u in batch["url"].to_pylist()]
            found = list(zip(batch["rule"].to_pylist(), batch["verdict"].to_pylist(), strict=True))
            for k, at in enumerate(table.look_up(parts)):
                if at >= 0 and (found[k][0] is None or _before(table.rule(at), found[k][0])):
                    found[k] = table.rule(at), table.verdict(at)
            columns = {"page_id": batch["page_id"]}
            if default is None:
                columns |= {"url": batch["url"]}
            else:
                columns |= {"host": [h for h, _ in parts], "path": [p for _, p in parts]}
            columns |= {"rule": [r for r, _ in found], "verdict": [v or default for _, v in found]}
            yield pa.RecordBatch.from_arrays([pa.array(c, None if n == "page_id" else pa.string()) for n, c in columns.items()], list(columns))

    return pages.mapInArrow(judge, RESULT if default is not None else pages.schema)


def _before(rule: str, other: str) -> bool:
    return (len(rule), rule.index("/")) > (len(other), other.index("/"))
