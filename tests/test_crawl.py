"""Least depths against breadth-first search in memory."""

import random
from collections import deque

import pytest

from corpusmill.operators import crawl
from corpusmill.operators.crawl import Levels, crawl_depths


def _search(pages, edges, starts, max_depth):
    out = {}
    for g, u in edges:
        out.setdefault(g, []).append(u)
    depth = {s: 1 for s in starts if s in pages}
    queue = deque(depth)
    while queue:
        u = queue.popleft()
        if depth[u] < max_depth:
            for v in out.get(u, []):
                if v in pages and v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
    return depth


def _run(spark, pages, edges, starts, max_depth=2**31 - 1, **options):
    one = lambda rows: spark.createDataFrame([(str(r),) for r in rows], "url string")
    links = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    got = crawl_depths(one(pages), links, one(starts), max_depth, **options)
    return {int(r.url): r.depth for r in got.collect()}


def _graph(seed):
    """Corridors one way and both ways, rings, dead ends, hubs and a core of random links."""
    x, edges, n = random.Random(seed), [], 0
    core = list(range(12))
    edges += [(x.choice(core), x.choice(core)) for _ in range(25)]
    n = len(core)
    for _ in range(8):
        length = x.randint(1, 9)
        walk = [x.choice(core), *range(n, n + length), *([x.choice(core)] if x.random() < 0.6 else [])]
        n += length
        edges += list(zip(walk, walk[1:]))
        if x.random() < 0.6:
            edges += list(zip(walk[1:], walk))
        if x.random() < 0.3:
            edges += [(v, 0) for v in walk]
        if x.random() < 0.3:
            edges.append((walk[-1], walk[len(walk) // 2]))
    edges += [(n, n + 1), (n + 1, n), (n + 1, n + 2), (n + 2, n + 2)]  # a ring that nothing enters
    pages = {v for v in range(n + 3) if x.random() < 0.95}
    return pages, edges, [0, x.randrange(n)]


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    pages, edges, starts = _graph(seed)
    for depth, rounds in ((2**31 - 1, 0), (2**31 - 1, 2), (4, 1)):
        assert _run(spark, pages, edges, starts, depth, plain_rounds=rounds) == _search(pages, edges, starts, depth), (seed, depth, rounds)


def test_long_chain(spark):
    """5,000 pages one behind the other, each with links back and to the first: no round per page."""
    n = 5000
    edges = [(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)] + [(i, 0) for i in range(1, n)]
    assert _run(spark, range(n), edges, [0], plain_rounds=3) == {i: i + 1 for i in range(n)}


def test_many_heads_in_few_rounds(spark, monkeypatch):
    """Sixty pages that can each be entered in several ways, one behind the other, take a fraction of as many rounds."""
    n, rounds = 60, []
    add = Levels.add
    monkeypatch.setattr(Levels, "add", lambda self, table, rows: (rounds.append(rows), add(self, table, rows))[1])
    edges = [(3 * i + a, 3 * i + 3) for i in range(n) for a in (1, 2)] + [(3 * i, 3 * i + a) for i in range(n) for a in (1, 2)] + [(3 * i + 3, 3 * i) for i in range(n)]
    pages = range(3 * n + 1)
    assert _run(spark, pages, edges, [0], plain_rounds=1) == _search(pages, edges, [0], 2**31 - 1)
    assert len(rounds) < n / 2


def test_estimates_stay_small(spark, monkeypatch):
    """Estimated sizes do not grow from round to round."""
    bits, plain = [], crawl.cut
    monkeypatch.setattr(crawl, "cut", lambda df: (bits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()), plain(df))[1])
    n = 24
    edges = [(3 * i + a, 3 * i + 3) for i in range(n) for a in (1, 2)] + [(3 * i, 3 * i + a) for i in range(n) for a in (1, 2)] + [(3 * i + 3, 3 * i) for i in range(n)]
    assert _run(spark, range(3 * n + 1), edges, [0], plain_rounds=1) == _search(range(3 * n + 1), edges, [0], 2**31 - 1)
    assert max(bits) < 2000


def test_sites_apart(spark):
    edges = spark.createDataFrame([(s, str(i), str(i + k)) for s, k in (("a", 1), ("b", 2)) for i in range(30)], "site string, src string, dst string")
    pages = spark.createDataFrame([(s, str(i)) for s in "ab" for i in range(31)], "site string, url string")
    starts = spark.createDataFrame([("a", "0"), ("b", "0")], "site string, url string")
    got = {(r.site, int(r.url)): r.depth for r in crawl_depths(pages, edges, starts, 25, by=("site",), plain_rounds=2).collect()}
    assert got == {("a", i): i + 1 for i in range(25)} | {("b", 2 * i): i + 1 for i in range(16)}


def test_few_tables(spark):
    """A hundred rounds of one page each leave a handful of tables."""
    levels = Levels(["url"], 2)
    for i in range(40):
        levels.add(spark.createDataFrame([(str(i // 2), i)], "url string, depth long"), 1)
        assert len(levels.tables) <= 6
    assert {r.url: r.depth for r in levels.all().collect()} == {str(i): 2 * i for i in range(20)}
