"""Operators that SQL cannot express, against brute-force versions on a small fixture with copies, near copies and pasted passages."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm.common import documents
from corpusmill.llm.decontamination import decontaminate
from corpusmill.llm.line_dedup import repeated_lines
from corpusmill.llm.mixing import mix, mixture
from corpusmill.llm.near_duplicates import near_duplicates
from corpusmill.llm.paragraph_dedup import repeated_paragraphs
from corpusmill.llm.queries import QUERIES
from corpusmill.llm.sharding import assign_shards
from corpusmill.llm.suffix_dedup import without_repeats
from corpusmill.llm.toxicity import held_out

from .conftest import prose


def _rows():
    rows = []
    base, passage = prose(1, 400), prose(2, 60)
    for i in range(60):
        words = prose(100 + i, 60 + 9 * i)
        if i % 3 == 0:
            words = base.copy()
            for k in range(i % 7):
                words[(37 * i + 61 * k) % 400] = "edit%d" % i
        if i % 4 == 1:
            at = (13 * i) % len(words)
            words = words[:at] + passage + words[at:]
        text = " ".join(words)
        if i % 5 == 0:
            text = text.replace("da", "da\n")
        rows.append((i + 1, text))
    rows += [(101, rows[0][1]), (102, rows[3][1].upper()), (103, "ab" * 500), (104, "short"), (105, "short")]
    return rows


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(docs_of):
    return docs_of(ROWS)


def _components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _similar(sets):
    return [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]


def _shingles(words, k=5):
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


@pytest.mark.parametrize("options", [{}, {"hot": 2, "run_size": 7, "part_size": 5}, {"run_size": 5}])
def test_suffix_array(docs, options):
    texts = {d: t.encode() for d, t in ROWS}
    seen = Counter(t[i:i + 200] for t in texts.values() for i in range(len(t) - 199))
    want = {}
    for d, t in texts.items():
        gone = set()
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone.update(range(i, i + 200))
        kept = bytes(c for i, c in enumerate(t) if i not in gone)
        want[d] = len(t), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()
    got = {r.doc_id: tuple(r)[1:5] for r in without_repeats(docs, **options).collect()}
    assert got == want and sum(n for _, n, *_ in want.values()) > 10_000


@pytest.mark.parametrize("options", [{}, {"small": 2, "task_classes": 2, "max_pivot_bytes": 8_000}])
def test_near_duplicates(docs, options):
    sets = [_shingles(re.findall(r"[^\x20\x09-\x0D]+", t.lower())) for _, t in ROWS]
    root = _components(len(ROWS), _similar(sets))
    want = {(d, len(sets[i]), ROWS[root[i]][0], root[i] == i) for i, (d, _) in enumerate(ROWS)}
    assert {tuple(r) for r in near_duplicates(docs, **options).collect()} == want
    assert len({w[2] for w in want}) < len(ROWS) - 15


def _with_equal(texts, sets):
    """Pairs of similar sets, and of equal texts with the first of their kind."""
    first = {}
    return _similar(sets) + [(first[x], i) for i, x in enumerate(texts) if first.setdefault(x, i) != i]


@pytest.mark.parametrize("options", [{}, {"few": 1, "pivots": 2}])
def test_lines(docs, options):
    lines = [(d, k, x) for d, t in ROWS for k, x in enumerate(t.split("\n")) if re.search(r"[\x21-\U0010FFFF]", x)]
    sets = [{x[i:i + 12] for i in range(len(x) - 11)} for *_, x in lines]
    root = _components(len(lines), _with_equal([x for *_, x in lines], sets))
    sizes = Counter(root)
    want = {(d, k, *lines[root[i]][:2], root[i] == i) for i, (d, k, _) in enumerate(lines) if sizes[root[i]] > 1}
    assert {tuple(r) for r in repeated_lines(docs, **options).collect()} == want and want


def test_paragraphs(docs):
    lines = []
    for d, t in ROWS:
        at = 0
        for x in t.split("\n"):
            words = x.lower().split()
            if words:
                lines.append((d, at, words))
            at += len(words)
    sets = [_shingles(w) if len(w) >= 20 else set() for *_, w in lines]
    root = _components(len(lines), _with_equal([tuple(w) for *_, w in lines], sets))
    sizes = Counter(root)
    want = {(*lines[i][:2], *lines[root[i]][:2]) for i in range(len(lines)) if sizes[root[i]] > 1}
    got = repeated_paragraphs(docs).collect()
    assert {(r.doc_id, r.first_word, r.kept_doc_id, r.kept_first_word) for r in got if not r.block} == want
    pasted = {d for i, (d, _) in enumerate(ROWS[:60]) if i % 4 == 1}
    assert pasted <= {r.doc_id for r in got if r.block}
    clean = {d for i, (d, _) in enumerate(ROWS[:60]) if i % 4 != 1 and i % 3}
    assert not clean & {r.doc_id for r in got if r.block}


def test_shards(docs):
    one = sorted(tuple(r) for r in assign_shards(docs).select("doc_id", "shard", "slot").collect())
    assert one == sorted(tuple(r) for r in assign_shards(docs.repartition(3)).select("doc_id", "shard", "slot").collect())
    counts = Counter(s for _, s, _ in one)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(slot for _, s, slot in one if s == shard) == list(range(n))


def test_slack_moves_little(spark):
    """With room to spare only documents of overfull shards move when a shard is added."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    old = {r.doc_id: r.shard for r in assign_shards(docs, shards=8, slack=0.25).collect()}
    new = {r.doc_id: r.shard for r in assign_shards(docs, shards=9, slack=0.25).collect()}
    assert max(Counter(old.values()).values()) <= 625
    assert sum(old[d] != new[d] for d in old) < 2400


def test_mix_reaches_targets(docs):
    words = Counter(r.source for r in mix(docs).collect() for _ in r.text.split())
    total = sum(len(t.split()) for _, t in ROWS)
    assert abs(sum(words.values()) - 1.5 * total) < 0.05 * total


def test_mix_of_equal_rows(docs_of):
    """A document that is there a thousand times is taken as often as brings its words to within half of it of the target."""
    rows = [(1, "five words are in here", "en", "a")] * 1000 + [(2, "other text of another source " * 700, "en", "b")] + [(i, "w " * (i % 7 + 1), "en", "c") for i in range(10, 400)]
    docs = docs_of(rows)
    found = mixture(docs).collect()
    target = next(r.target for r in found if r.doc_id == 1)
    assert len(found) == len(rows) and abs(sum(r.taken for r in found if r.doc_id == 1) - target) <= 2.5
    taken = Counter(r.doc_id for r in found for _ in range(r.taken // r.size if r.size else 0))
    assert Counter(r.doc_id for r in mix(docs).collect()) == taken


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op4_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(held_out(F.col("doc_id")))
    rows = scored.join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9


def test_pipeline(spark):
    """The stages one by one, with brute force for near-duplicates, against run()."""
    sf = "/root/testdata/sf0.001"
    clean = corpus_pipeline.toxicity(spark, documents(spark, sf), sf)
    rows = sorted(clean.collect(), key=lambda r: r.doc_id)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    root = _components(len(rows), _similar([_shingles(re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(lower))) for r in rows]))
    unique = spark.createDataFrame([r for i, r in enumerate(rows) if root[i] == i], clean.schema)
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = set()
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = token.findall(item.text.translate(lower))
        grams |= {tuple(w[i:i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(g) for g in grams}
    free = [r for r in unique.collect() if not any(
        tuple(w[i:i + n]) in grams for w in [token.findall(r.text.translate(lower))] for n in sizes for i in range(len(w) - n + 1))]
    assert {r.doc_id for r in decontaminate(unique, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()} == {r.doc_id for r in free}
    want = sorted(tuple(r) for r in assign_shards(mix(spark.createDataFrame(free, clean.schema))).select("doc_id", "shard", "slot").collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "shard", "slot").collect()) == want
