import collections
import hashlib
import re

import pytest
from docs import corpus, table
from pyspark.sql import functions as F

from verisift.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, cap=3.0):
    """Water-filling, one source at a time."""
    total, out, free = sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(out.values())) / sum(weights[s] for s in free)
        over = {s for s in free if cap * sizes[s] < level * weights[s]}
        if not over:
            return out | {s: level * weights[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("bucket_rows,few", [(2000, 100), (3, 100), (3, 0)])
def test_targets_and_counts(spark, bucket_rows, few, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    monkeypatch.setattr(mixing, "RANKED_ROWS", 2)
    rows = corpus(5, 300) + [(1000 + i, "w " * 700, "en", "tiny", 1) for i in range(1)] + [(2000 + i, "w " * (i % 50), "en", "hot", 1) for i in range(400)]
    d = table(spark, rows)
    got = mixing.mix(d, seed=9).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    sizes, most = collections.Counter(), collections.Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or ""))
        sizes[r.source] += r["size"]
        most[r.source] = max(most[r.source], r["size"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    # the seeded order, one document at a time
    text, ident = (lambda r: r.text or ""), (lambda r: "" if r.doc_id is None else str(r.doc_id))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for s in sizes:
        part, at = (want[s] - want[s] // sizes[s] * sizes[s] if sizes[s] else 0), 0
        for r in sorted((r for r in got if r.source == s), key=lambda r: md5(f"9\x01{ident(r)}\x01{md5(text(r))}")):
            assert r.copies == (want[s] // sizes[s] if sizes[s] else 0) + (part > 0 and at + r["size"] / 2 <= part) or abs(at + r["size"] / 2 - part) < 1e-6
            at += r["size"]
    again = mixing.mix(d.repartition(7), seed=9).collect()
    key = lambda rs: sorted((r.doc_id, r.copies, r.text or "") for r in rs)
    assert key(got) == key(again)


def test_given_weights_and_rows(spark):
    d = table(spark, [(i, "a b c d", None, "x" if i % 4 else "y", 4) for i in range(40)])
    w = spark.createDataFrame([("x", 1.0), ("y", 9.0)], "source string, weight double")
    m = mixing.mix(d, w, seed=1)
    t = {r.source: r.target for r in m.select("source", "target").distinct().collect()}
    assert t == {"y": 120.0, "x": 40.0}
    rows = mixing.repeated(m, d.columns)
    assert rows.columns == d.columns and {r.source: r["count"] for r in rows.groupBy("source").count().collect()} == {"y": 30, "x": 10}


def test_weights_by_range_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED_ROWS", 3)
    names = [f"s{i:02d}" for i in range(20)] + ["é", "Z", None]
    d = spark.createDataFrame([(n,) for n in names * 2], "source string")
    got = {r.source: r.weight for r in mixing.cyclic_weights(d, "source").collect()}
    order = sorted(names, key=lambda s: (s is None, s or ""))
    assert got == {s: i % 3 + 1 for i, s in enumerate(order)}


def test_size_may_read_clashing_columns(spark):
    d = table(spark, [(i, "a", None, "x", 1) for i in range(6)]).withColumn("size", F.lit(5)).withColumn("target", F.lit("t"))
    got = mixing.mix(d, size=F.col("size").cast("long") * 2).collect()
    assert {(r["size"], r.source_size, r.target, r.copies) for r in got} == {(10, 60, 60.0, 1)}


def test_edges(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    d = table(spark, [(1, None, None, None, None), (2, "", None, "a", 0), (None, "a b", None, "b", 3), (None, "a b", None, "b", 3)])
    got = mixing.mix(d.withColumn("size", F.lit("clash"))).collect()
    assert sorted((r.doc_id or 0, r["size"], r.copies) for r in got) == [(0, 2, 1), (0, 2, 1), (1, 0, 0), (2, 0, 0)]
