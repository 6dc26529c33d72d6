import hashlib
import random
import zlib

import pytest
from docs import table
from pyspark.sql import functions as F

from verisift.llm import conversation_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    """One conversation and one prefix at a time."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        full[c] = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[b] for b in below) if below else 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[b] for b in below)
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(full[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(tuple(r) for r in rows)


def check(spark, rows, rebuild=True, parts=3, schema=TURNS):
    c = F.col("conv")
    more = {"lender": c - c % 5, "lent": F.crc32(c.cast("string").cast("binary")) % 9} if rebuild else {}
    got = conversation_trie.prefix_trie(table(spark, rows, schema).repartition(parts), **more)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(str, order(got.collect()))) == sorted(map(str, order(brute([r[:4] for r in rows], rebuild))))


def sample(rng, convs, deepest):
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, deepest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"t{rng.randrange(2)}" if t < 3 or rng.random() < 0.7 else f"é{c} {t}"))
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_brute_force(spark, rebuild, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK_BITS", 2)
    monkeypatch.setattr(conversation_trie, "LEAST_HEIGHT", 3)
    monkeypatch.setattr(conversation_trie, "ENDS_BITS", 2)
    rng = random.Random(13)
    rows = sample(rng, range(-7, 40), 12) + sample(rng, [101, 104], 40)
    # nulls, ties, repeated rows, a conversation without a turn number
    rows += [(None, 0, "user", "lost"), (50, None, None, None), (50, 1, "user", None), (50, 1, "assistant", "tie"), (50, 1, "user", "tie"), (50, 1, "user", "tie"), (60, 0, "user", "x" * 100_000), rows[0], rows[0]]
    rng.shuffle(rows)
    check(spark, rows, rebuild)


def test_hot_conversation_and_common_turns(spark, monkeypatch):
    """A third of all turns in one conversation; most conversations alike; a parent with very many children is joined by broadcast."""
    monkeypatch.setattr(conversation_trie, "CHUNK_BITS", 3)
    monkeypatch.setattr(conversation_trie, "HOT_SHARE", 3)
    rows = [(5, t, "user", f"turn {t}") for t in range(60)] + [(c, t, "user", f"same {t}") for c in range(10, 30) for t in range(3)] + [(c, 0, "user", f"own {c}") for c in range(40, 100)]
    check(spark, rows, False, 7)
    check(spark, rows, True, 2)


def test_lender_longer_than_the_conversation(spark):
    """h above a conversation's length, and lenders that are absent: rebuilt conversations without a turn are members of the root alone."""
    rows = [(c, t, "user", f"{c % 2} {t}") for c in range(1, 90, 2) for t in range(2)]
    check(spark, rows)


def test_empty_and_extra_columns(spark):
    assert conversation_trie.prefix_trie(table(spark, [], TURNS)).collect() == []
    assert conversation_trie.prefix_trie(table(spark, [(None, 1, "a", "b")], TURNS)).collect() == []
    rows = [(1, 0, "u", "a", "x", 1, 2), (2, 0, "u", "a", "y", 3, 4)]
    check(spark, rows, False, 1, TURNS + ", md5 string, depth long, k1 long")


def test_other_names(spark):
    d = table(spark, [(1, 0, "u", "a")], "c long, n long, who string, said string")
    got = conversation_trie.prefix_trie(d, conv_col="c", turn_col="n", role_col="who", text_col="said").collect()
    assert sorted((r.depth, r.n_convs) for r in got) == [(0, 1), (1, 1)]
