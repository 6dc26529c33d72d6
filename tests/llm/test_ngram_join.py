import collections
import random
import re

import pytest
from docs import corpus, table
from pyspark.sql import functions as F

from verisift.llm import ngram_join
from verisift.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))


def chain(seed, n):
    """Near copies around the threshold: edits of one base, so that links are many and far from complete."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(40)}"
        out.append((10_000 + i, " ".join(w), None, None, 1))
    return out


@pytest.mark.parametrize("short,common,batch", [(64, 48, 1_500_000), (2, 3, 400)])
def test_against_brute_force(spark, short, common, batch, monkeypatch):
    for k, v in (("SHORT", short), ("COMMON", common), ("BATCH", batch), ("BLOCK_S", 4), ("BLOCK_M", 7)):
        monkeypatch.setattr(ngram_join, k, v)
    rows = corpus(11, 200) + chain(3, 90)
    d = table(spark, rows).repartition(3)
    d = spark.createDataFrame(d.collect(), d.schema)
    got = ngram_join.near_duplicates(d).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_threshold_is_exact(spark):
    w = [f"t{i}" for i in range(104)]  # 100 shingles
    near = w[:4] + ["q"] * 0 + w[4:]
    rows = [(1, " ".join(w), None, None, 1), (2, " ".join(near[:-20] + [f"u{i}" for i in range(8)]), None, None, 1), (3, " ".join(w[:84]), None, None, 1), (4, " ".join(w[:83]), None, None, 1)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(table(spark, rows)).collect()}
    assert sorted((i, c) for i, c in got.items()) == [(i, c) for i, _, c in brute(rows)]
    assert got[3] == 1


def test_edges(spark):
    assert ngram_join.near_duplicates(table(spark, [])).count() == 0
    rows = [(None, "a b c d e f", None, None, 1), (5, "a b c d e f", None, None, 1), (None, "x", None, None, 1), (7, None, None, None, 1), (8, "  ", None, None, 1), (8, "  ", None, None, 1)]
    d = table(spark, rows).withColumnRenamed("lang", "cls").withColumnRenamed("source", "component_id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(d).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (None, 1, None), (7, 0, 7), (8, 0, 8), (8, 0, 8)], key=str)
    kept = ngram_join.keep_one(table(spark, rows))
    # 5 stays for its group with the row without an id; the other row without one is alone; 7 and both rows of 8 have no words
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 5), (False, 7), (False, 8), (False, 8), (True, 0)]


def test_keep_one_decides_by_row(spark):
    """Two texts under one id; copies under one id; copies without an id; rows without words."""
    t = lambda seed: " ".join(f"w{(seed * 7919 + k * 31) % 997}" for k in range(40))
    rows = [(1, t(1)), (1, t(2)), (2, t(2)), (3, t(3)), (3, t(3)), (None, t(4)), (None, t(4)), (None, t(3)), (9, " "), (9, " "), (None, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("o", F.lit(1)))
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == collections.Counter([(1, t(1)), (1, t(2)), (3, t(3)), (None, t(4)), (9, " "), (9, " "), (None, None)]) and kept.columns == ["doc_id", "text", "o"]


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {v: find(v) for e in edges for v in e if e[0] != e[1]} | {v: find(v) for v in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
