import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.llm import hard_negatives

BIG = float(np.finfo(np.float64).max)
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=5, k=5, most=3):
    """One anchor, one positive and one negative at a time, in whole numbers."""
    ok = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(max(-BIG, min(BIG, 256 * x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    order = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = []
    for a, (ai, av, al) in enumerate(ok):
        if ai is None or ai % every:
            continue
        scores = [(held(sum(x * y for x, y in zip(av, bv))), bi, bl == al) for b, (bi, bv, bl) in enumerate(ok) if b != a]
        for ps, pi, _ in sorted((s for s in scores if s[2]), key=order)[:k]:
            fits = sorted((s for s in scores if not s[2] and 50 * ps <= 100 * s[0] <= 95 * ps), key=order)[:most]
            out += [(ai, pi, r + 1, ni, ps, ns) for r, (ns, ni, _) in enumerate(fits)]
    return out


def mined(spark, rows, every=5, parts=3, schema=SCHEMA):
    d = spark.createDataFrame(rows, schema).repartition(parts)
    return hard_negatives.mine(d, anchor=F.col("vec_id") % every == 0, label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def same(got, want):
    key = lambda rs: sorted(map(str, (tuple(r) for r in rs)))
    assert key(got) == key(want)


def clustered(seed, n, dim=8, labels=4, noise=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        out.append((i, [float(x) for x in centres[int(rng.integers(labels)) if i % 3 == 0 else label] + noise * rng.normal(size=dim)], label))
    return out


@pytest.mark.parametrize("window,buffer,bytes_", [(128, 500_000, 16_000_000), (5, 50, 8 * 8 * 7)])
def test_equals_brute_force(spark, window, buffer, bytes_, monkeypatch):
    """Also with small windows, cuts and passes of seven anchors."""
    monkeypatch.setattr(hard_negatives, "WINDOW_ROWS", window)
    monkeypatch.setattr(hard_negatives, "BUFFER", buffer)
    monkeypatch.setattr(hard_negatives, "PASS_BYTES", bytes_)
    rows = clustered(3, 220)
    want = brute(rows)
    assert len(want) > 100
    same(mined(spark, rows).collect(), want)


def test_ties_copies_nulls_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "WINDOW_ROWS", 4)
    rng = random.Random(5)
    rows = clustered(4, 60, 3, 3)
    rows += [rows[5], rows[5], rows[10]]  # repeated rows, an anchor among them
    rows += [(100 + i, [1.0, 0.5, 0.25], i % 3) for i in range(24)]  # one hot vector
    rows += [(None, [1.0, 0.5, 0.2], 1), (200, None, 1), (205, [1.0, None, 0.0], 1), (210, [1.0, float("nan"), 0.0], 1), (215, [float("inf"), 1.0, 0.0], 1), (220, [1.0, 1.0, 1.0], None)]
    rows += [(225, [0.0, 0.0, 0.0], 1), (230, [], 2), (235, [2.0], 0), (240, [-1.0, -0.5, -0.25], 2), (1, [1e-9, 0.0, -1e-9], 0)]
    rng.shuffle(rows)
    # shorter vectors are filled with zeros
    same(mined(spark, rows).collect(), brute([(i, v if v is None else v + [0.0] * (3 - len(v)), x) for i, v, x in rows]))


def test_large_components(spark):
    """Products beyond 2**53 are exact; beyond 64 bits they are held at the ends."""
    rows = [(i, [float((-1) ** i * 3.1e7 * (i % 11 + 1)), 1e6 + i / 7, float(i)], i % 2) for i in range(30)]
    same(mined(spark, rows).collect(), brute(rows))
    rows += [(50, [1e200, 1.0, 0.0], 0), (55, [-1e300, 2.0, 0.0], 1), (60, [1e308, 1e308, 1.0], 0)]
    same(mined(spark, rows).collect(), brute(rows))


def test_empty_and_single(spark):
    assert mined(spark, []).collect() == []
    assert mined(spark, [(5, [1.0], 1)]).collect() == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]).collect() == []
    assert mined(spark, [(5, None, 1)]).collect() == []


def test_extra_columns(spark):
    rows = clustered(6, 40, 4, 2)
    d = [(*r, "x", 1, True) for r in rows]
    same(mined(spark, d, schema=SCHEMA + ", ref string, aid int, anchor boolean").collect(), brute(rows))


def test_bounds_hold_and_prune():
    """No score lies outside its window's bounds; on clustered vectors most windows are left out."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = np.floor(256 * np.concatenate([c + 0.05 * rng.normal(size=(200, 16)) for c in centres]))
    refs = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    block = lambda y: hard_negatives.Block(np.zeros(len(y)), np.zeros(len(y), bool), np.zeros(len(y)), y, *hard_negatives.angles_to(y, refs))
    a, out, left = block(x[::40]), 0, 0
    for i in range(0, len(x), 100):
        low, high = hard_negatives.bounds(a, block(x[i : i + 100]))
        s = hard_negatives.products(a.x, x[i : i + 100])
        assert (s >= low[:, None]).all() and (s <= high[:, None]).all()
        out, left = out + len(a.x), left + int((high < np.sort(hard_negatives.products(a.x, x), axis=1)[:, -6]).sum())
    assert left > 0.7 * out
