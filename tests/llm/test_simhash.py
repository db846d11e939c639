"""SimHash components against all pairs of fingerprints that are counted bit by bit."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from corpusmill.llm import simhash
from corpusmill.llm.simhash import fingerprint, fingerprint_links, similar_fingerprints

from .conftest import prose


def _bits(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(values, distance):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(values)), 2):
        if bin(values[i] ^ values[j]).count("1") <= distance:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def _rows():
    rows = []
    for i in range(30):
        words = prose(i, 300)
        rows.append((3 * i, " ".join(words)))
        words[i] = "Edited"
        rows.append((3 * i + 1, "\t".join(words)))
        words[200 + i:] = words[201 + i:]
        rows.append((3 * i + 2, "\n ".join(words).upper()))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "two words"), (504, "Two  WORDS"), (504, "Two  WORDS"), (None, "two words"), (None, "alone"),
                   (505, "Été x 　 \x1c y z"), (506, "x" * 3_000_000 + " b c"), (507, "a b c " * 400_000)]


@pytest.mark.parametrize("options", [{}, {"dense": 2}, {"distance": 7}, {"distance": 1}, {"distance": 0}])
def test_components(docs_of, options):
    rows = _rows()[:-1] if options else _rows()
    bits = [_bits(t) for _, t in rows]
    root = _roots(bits, options.get("distance", 3))
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = sorted(((d, f"{b:016x}", least[r]) for (d, _), b, r in zip(rows, bits, root)), key=str)
    assert sorted((tuple(r) for r in similar_fingerprints(docs_of(rows), **options).collect()), key=str) == want
    assert options.get("distance") == 0 or len({w[2] for w in want}) < len({w[1] for w in want})


@pytest.mark.parametrize("dense", [4096, 50, 3])
def test_dense_buckets(spark, dense):
    """Many fingerprints around one, at distances up to eight, and chains that only their neighbours connect."""
    x = random.Random(7)
    center, values = x.getrandbits(64), set()
    for _ in range(1500):
        v = center
        for b in x.sample(range(64), x.randint(0, 8)):
            v ^= 1 << b
        values.add(v)
    v = x.getrandbits(64)
    for i in range(60):  # a chain
        values.add(v)
        for b in x.sample(range(64), 3):
            v ^= 1 << b
    values = sorted(values)
    root = _roots(values, 3)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "bits long"), dense=dense).collect()
    at = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        a, b = find(at[r.a]), find(at[r.b])
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(values))] == root


def test_every_linked_pair_meets(spark):
    """Every pair within the distance shares a bucket, wherever its bits differ."""
    x = random.Random(11)
    values = []
    for bits in [*combinations(range(0, 64, 7), 3), *combinations(range(14, 19), 2), (0,), (63,), (15, 16, 17), (16, 17, 18)]:
        v = x.getrandbits(64)
        values.append((v, v ^ sum(1 << b for b in bits)))
    signed = [tuple(np.array(p, np.uint64).view(np.int64).tolist()) for p in values]
    found = {frozenset((r.a, r.b)) for r in fingerprint_links(spark.createDataFrame([(v,) for p in signed for v in p], "bits long")).collect()}
    assert found == {frozenset(p) for p in signed}


def test_blocks(monkeypatch):
    """A text is hashed alike in blocks of any size."""
    text = " ".join(prose(3, 400)) + "  \n" + "long" * 50 + "é  end"
    want = _bits(text)
    for size in (1 << 20, 100, 7, 1):
        monkeypatch.setattr(simhash, "BLOCK", size)
        assert fingerprint(text.encode(), 3) == want


def test_empty_table(docs_of):
    assert similar_fingerprints(docs_of([(1, "x")]).limit(0)).collect() == []
