"""The manifest against a tree that is built whole in memory, and proofs that hold for what is there and for nothing else."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.merkle import build_manifest, folded, leaf_digest, proof_digest, prove
from corpusmill.llm.queries import QUERIES

from .conftest import prose

KINDS = "doc_id long, text string, lang string, source string, n_chars long, pos string, digest string"


def _rows():
    langs = ["en"] * 70 + ["de"] * 17 + ["fr"] * 16 + [None] * 5 + [""] + ["é"] * 2 + ["zz"] * 33
    rows = [((37 * i) % 1000 - 300, " ".join(prose(i, 5 + i % 9)), lang, "ab"[i % 2], None if i % 11 == 0 else i) for i, lang in enumerate(langs)]
    rows += [(None, "no id", "en", None, 1), (None, "no id", "en", None, 1), (7, None, "en", "a", 2**63 - 1), (7, "", "en", "a", 0), (7, "", "en", "a", 0), (8, "x" * 3_000_000, "de", "a", 3)]
    return [(*r, "p", "d") for r in rows]


def _h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(doc_id, text, lang, source, n_chars):
    return _h(*map(_field, (doc_id, source, lang, n_chars, text)))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _path(levels, i):
    """(sibling or None, whether it stands left) from below the top down to the leaf, reversed."""
    return [(level[(i >> j) ^ 1] if (i >> j) ^ 1 < len(level) else None, bool(i >> j & 1)) for j, level in enumerate(levels[:-1])]


def _want(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(*r[:5]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    high = _levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = _path(trees[g], i) + _path(high, k)
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                now = _leaf(*r[:4], r[4] + 1)
            for other, left in path:
                now = _h(now) if other is None else _h(other, now) if left else _h(now, other)
            out.append((r[0], leaf, trees[g][-1][0], high[-1][0], _h(*[o or "" for o, _ in path]), now, now == high[-1][0]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), KINDS)


@pytest.mark.parametrize("stride", [8, 3, 1])
def test_tree(docs, stride):
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))
    manifest = build_manifest(docs, stride=stride, carry={"now": tampered})
    found = prove(manifest).withColumn("again", folded(F.coalesce("now", "leaf"), F.col("siblings"), F.col("left"))).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("siblings")), "again", F.col("again") == F.col("root"))
    want = _want(_rows())
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert manifest.root() == want[0][3]
    assert {w[6] for w in want} == {True, False}


def test_query(docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_merkle_manifest"](docs.sparkSession, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _want(_rows())


def test_some_proofs(docs, spark):
    """Proofs of chosen rows are the same, and read only their blocks."""
    manifest = build_manifest(docs, stride=2)
    chosen = spark.createDataFrame([(7,), (8,), (10**6,), (None,)], "doc_id long")
    every = {(r.doc_id, r.group, r.pos): r for r in prove(manifest).collect()}
    some = {(r.doc_id, r.group, r.pos): r for r in prove(manifest, chosen).collect()}
    assert some == {k: r for k, r in every.items() if k[0] in (7, 8, None)} and len(some) == 6


def test_another_manifest(docs, spark):
    """A proof of one dataset does not hold in another that differs by a field, a row or its order."""
    root = build_manifest(docs).root()
    assert root == build_manifest(docs.repartition(7)).root()
    for other in (docs.filter("doc_id <> 8 OR doc_id IS NULL"), docs.withColumn("source", F.upper("source")), docs.unionByName(docs.limit(1)),
                  docs.withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))):
        assert build_manifest(other).root() != root
    by_source = build_manifest(docs, group="source", fields=("doc_id", "text"))
    assert by_source.root() != root and prove(by_source).count() == docs.count()


@pytest.mark.parametrize("n", [0, 1, 2, 256, 257])
def test_sizes(spark, n):
    rows = [(i, "t", "en", "s", 1, "p", "d") for i in range(n)]
    docs = spark.createDataFrame(rows, KINDS)
    manifest = build_manifest(docs)
    assert manifest.root() == (_want(rows)[0][3] if n else None)
    assert prove(manifest).filter(folded(F.col("leaf"), F.col("siblings"), F.col("left")) == F.col("root")).count() == n
