"""The trie against one that is built of whole prefixes in memory."""

import hashlib
import random
import re
import zlib

import pytest

from corpusmill.llm import prefix_trie as P
from corpusmill.llm.queries import QUERIES

KINDS = "conv_id long, turn long, role string, text string, depth string, n string"


def _brute(sequences):
    """Rows of the contract from ``{conv_id: [(role, text), ...]}``."""
    members, ends = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, ms in members.items():
        own = (len(ms) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not children[p]
    return sorted(((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, ms in members.items()), key=str)


def _rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def _rows():
    x, rows = random.Random(3), []
    for c in [*range(-25, 90), 10**12, 10**12 + 3]:
        if c in (40, 60):  # their followers have no head
            continue
        some = [("user", "hi"), ("assistant", "hello  there\nyou"), ("user", "x" * (c % 3))]
        n = x.choice([1, 1, 2, 3, 5, 9])
        own = some[:n] if c % 3 == 0 else [(x.choice(["user", "system"]), f"t {x.randint(0, 2)}") for _ in range(n)]
        rows += [(c, i * 2, r, t) for i, (r, t) in enumerate(own)]
    rows += [(100, i, "user", f"long {i % 5}") for i in range(150)] + [(105, i, "user", f"long {i % 5}") for i in range(140)] + [(111, i, "user", f"long {i % 5}") for i in range(64)]
    rows += [(120, None, None, None), (120, 5, None, "a"), (120, 5, "", "a"), (120, 5, "b", ""), (121, 0, "é", "\U0001F600 w"), (122, 7, "u", "w " * 200_000), (None, 1, "user", "nobody's")]
    x.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*r, "d", "n") for r in _rows()], KINDS)


@pytest.mark.parametrize("options", [{}, {"limit": 1}, {"limit": 2, "segment": 3}, {"limit": 1, "segment": 1}, {"segment": 7}])
def test_trie(conversations, options):
    turns, convs = P.rebuilt(P.numbered_turns(conversations))
    nodes = P.prefix_trie(turns, convs, **options).collect()
    assert sorted((tuple(r)[2:] for r in nodes), key=str) == _brute(_rebuilt(_rows()))
    names = {bytes(r.name): r for r in nodes}
    assert len(names) == len(nodes)
    assert all(names[bytes(r.parent)].depth == r.depth - 1 if r.depth else r.parent is None for r in nodes)


def test_query(conversations, tmp_path):
    conversations.write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op12_prefix_trie"](conversations.sparkSession, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(_rebuilt(_rows()))


def test_many_copies(spark, monkeypatch):
    """Ids of one end come in many pieces; their hash is that of the whole text."""
    monkeypatch.setattr(P, "PIECE", 7)
    rows = [(20 * c, t, "user", f"same {t}") for c in range(300) for t in range(3)] + [(20 * c, t, "user", f"same {t} {c % 3 if t > 1 else ''}") for c in range(300, 600) for t in range(3)]
    turns, convs = P.rebuilt(P.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    nodes = P.prefix_trie(turns, convs, limit=2).drop("name", "parent").collect()
    assert sorted((tuple(r) for r in nodes), key=str) == _brute(_rebuilt(rows))


def test_snapshots(spark):
    """Every conversation goes on where the one before ended, so the trie is one long path of single children."""
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(40) for t in range(c + 1)]
    turns, convs = P.rebuilt(P.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), heads=P.F.lit(0))
    for options in {}, {"limit": 3, "segment": 4}:
        nodes = P.prefix_trie(turns, convs, **options).drop("name", "parent").collect()
        assert sorted((tuple(r) for r in nodes), key=str) == _brute({20 * c: [("user", f"turn {t}") for t in range(c + 1)] for c in range(40)})


def test_empty_table(conversations):
    turns, convs = P.rebuilt(P.numbered_turns(conversations.limit(0)))
    assert P.prefix_trie(turns, convs).collect() == []
