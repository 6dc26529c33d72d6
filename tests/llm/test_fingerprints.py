import base64
import hashlib
import random

import numpy as np
import pytest
from docs import corpus, table
from pyspark.sql import functions as F

from verisift.llm import fingerprints as fp


def test_difference_is_exact():
    rng = random.Random(2)
    sets = [sorted({rng.getrandbits(64) for _ in range(n)}) for n in (0, 1, 5, 40, 400, 3000)]
    import numpy as np

    pairs = []
    for a in sets:
        for drop in (0, 1, 7, 10**6):
            b = sorted(set(a[drop:]) | {rng.getrandbits(64) for _ in range(drop % 50)})
            pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
    got = fp.difference([p[0] for p in pairs], [p[1] for p in pairs])
    for (a, b), (x, y) in zip(pairs, got):
        assert set(x.tolist()) == set(a.tolist()) - set(b.tolist()) and set(y.tolist()) == set(b.tolist()) - set(a.tolist())


def likeness(a, b):
    x, y = set(fp.digests(a).tolist()), set(fp.digests(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("each", [12 << 20, 4000])
def test_against_brute_force(spark, each, monkeypatch, tmp_path):
    rows = corpus(7, 60) + [(500 + i, "One. Two, three!\n" * i, None, None, 1) for i in range(30)]
    rows += [(77, f"hot id {i % 40}", None, None, 1) for i in range(300)] + [(None, f"no id {i % 9}", None, None, 1) for i in range(200)] + [(78, "one row, many times", None, None, 1)] * 300
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(fp, "RUN_BYTES", each)
    runs = [r["count"] for r in fp.with_next(d)[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(runs) == 1 if each > 4000 else max(runs) <= 4 * sum(runs) / len(runs) and len(runs) > 9
    got = fp.fingerprint(d).collect()
    assert len(got) == len(rows)
    ties = {r.t: r.h for r in table(spark, rows).select(F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()}
    texts = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]), reverse=True)
    want = []
    for i, (ident, t) in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)][1]
        e = fp.edited(t, nxt)
        assert len(e) <= len(t)
        want.append((ident, len(t), hashlib.sha256(e.encode()).hexdigest(), round(likeness(t, e), 9), round(likeness(t, nxt), 9)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))) for r in got)
    same = {}
    for r in got:
        if r.doc_id is not None and r.doc_id not in (10, 12, 77):
            text = next(t for i, t in texts if i == r.doc_id)
            assert same.setdefault(text, r.fingerprint) == r.fingerprint


def test_fingerprints_subtract():
    """From the text form alone: cells subtract, and peel to the differing digests, with counts beyond two bytes too."""
    a = fp.digests("One. Two. Three. Four.")
    b = fp.digests("One. Two. Five. Four.")
    cells = [np.frombuffer(base64.b64decode(x), np.uint8).reshape(fp.CELLS, fp.CELL_BYTES) for x in fp.fingerprints([a, b])]
    count, key, check = (lambda c: c[:, :4].copy().view("<u4").ravel().astype(int)), (lambda c: c[:, 4:12].copy().view("<u8").ravel()), (lambda c: c[:, 12:].copy().view("<u4").ravel())
    t = fp.Tables(np.array([fp.CELLS // fp.HASHES]), 0)
    t.count[:], t.key[:], t.check[:] = count(cells[0]) - count(cells[1]), key(cells[0]) ^ key(cells[1]), check(cells[0]) ^ check(cells[1])
    _, k, side, bad = t.peel()
    assert not bad.any() and set(k[side > 0].tolist()) == set(a.tolist()) - set(b.tolist()) and set(k[side < 0].tolist()) == set(b.tolist()) - set(a.tolist())
    many = np.random.default_rng(1).integers(0, 2**63, 2_000_000).astype(np.uint64)
    big = np.frombuffer(base64.b64decode(fp.fingerprints([many])[0]), np.uint8).reshape(fp.CELLS, fp.CELL_BYTES)
    assert count(big).sum() == fp.HASHES * len(many) and count(big).min() > 65535


def test_edges(spark):
    one = fp.fingerprint(table(spark, [(4, "a. b", None, None, 1)])).collect()[0]
    assert one.near_next == 1.0 and one.n_chars == 4
    assert fp.fingerprint(table(spark, [])).count() == 0
    nulls = fp.fingerprint(table(spark, [(None, "a", None, None, 1), (None, None, None, None, 1), (None, "b", None, None, 1)]))
    assert nulls.count() == 3
    mixed = fp.fingerprint(table(spark, [(None, "a", None, None, 1), (3, "b", None, None, 1), (3, "b", None, None, 1)]).withColumnRenamed("lang", "n_characters"))
    assert mixed.count() == 3
    assert len(fp.paragraphs("word " * 500)) >= 1 and fp.paragraphs(" \n ") == set()
