import collections
import math
from decimal import Decimal, localcontext

import numpy as np
import pytest
from docs import corpus, table
from pyspark.sql import functions as F

from verisift.llm import sharding


def test_matrix_rows_add_up():
    sizes = np.array([5, 0, 17, 3, 40, 9])
    _, _, cells = sharding.cell_sizes(int(sizes.sum()), 5, 4)
    rows = np.array([sharding.matrix_row(sizes, cells, p, 3) for p in range(len(sizes))])
    assert (rows.sum(axis=0) == cells).all() and (rows.sum(axis=1) == sizes).all()


def test_large_counts_stay_exact():
    cells = np.full(4, 10**9, np.int64)
    got = sharding.hypergeometric(np.random.default_rng(1), cells, 10**9)
    assert got.sum() == 10**9 and (got >= 0).all()


@pytest.mark.parametrize("a,b,n", [(7, 5, 6), (40, 3, 20), (300, 700, 90), (1, 1, 1), (50, 50, 100), (2, 998, 500)])
def test_rejection_sampler_keeps_the_law(a, b, n):
    """Against the exact probabilities, by chi square."""
    rng, draws = np.random.default_rng(5), 3000
    got = collections.Counter(sharding._binary(rng, a, b, n, most=0) for _ in range(draws))
    want = {k: math.comb(a, k) * math.comb(b, n - k) / math.comb(a + b, n) for k in range(max(0, n - b), min(a, n) + 1)}
    assert set(got) <= set(want)
    big = {k: p * draws for k, p in want.items() if p * draws >= 5}
    rest = draws - sum(big.values())
    chi = sum((got[k] - e) ** 2 / e for k, e in big.items()) + ((sum(got.values()) - sum(got[k] for k in big) - rest) ** 2 / rest if rest > 1 else 0)
    assert chi < len(big) + 5 * math.sqrt(2 * len(big)) + 5


def test_rejection_sampler_beyond_numpys_range():
    rng, a, b, n = np.random.default_rng(6), 3 * 10**11, 7 * 10**11, 10**11
    x = np.array([sharding._binary(rng, a, b, n) for _ in range(300)], float)
    mean, var = n * 0.3, n * 0.3 * 0.7 * 0.9
    assert abs(x.mean() - mean) < 5 * math.sqrt(var / 300) and 0.75 < x.var() / var < 1.3
    with localcontext() as c:
        c.prec = 60
        assert all(abs(sharding.log_factorial(k) - Decimal(math.factorial(k)).ln()) < Decimal("1e-38") for k in (0, 1, 999, 1000, 1234))


def test_against_a_shuffle_of_the_whole(spark, tmp_path):
    """The law of (place before, place after) equals that of a plain permutation: each row is as likely at each slot, pairs too."""
    spark.range(6, numPartitions=2).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    sizes = [r.n for r in d.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    _, _, cells = sharding.cell_sizes(6, 2, 2)
    # without Spark: the same dealing and ranking, many seeds
    pairs, n = collections.Counter(), 4000
    for seed in range(n):
        labels = []
        for p, k in enumerate(sizes):
            rng = np.random.default_rng([seed, 0, p])
            to = rng.permutation(np.repeat(np.arange(len(cells)), sharding.matrix_row(np.array(sizes), cells, p, seed)))
            labels += list(zip(to.tolist(), rng.integers(-(2**62), 2**62, k).tolist()))
        order = sorted(range(6), key=lambda i: labels[i])
        pairs[order.index(0), order.index(5)] += 1
    assert len(pairs) == 30 and all(abs(c - n / 30) < 5 * math.sqrt(n / 30) for c in pairs.values())
    got = sharding.shard(d, 2, seed=3, block_rows=2)
    assert got.groupBy("shard").count().collect() and {(r.shard, r.slot) for r in got.collect()} == {(s, k) for s in range(2) for k in range(3)}


def test_exact_sizes_and_gapless_slots(spark, tmp_path):
    table(spark, corpus()).repartition(5).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    for blocks in (8192, 3):
        got = sharding.shard(d, 7, seed=2, block_rows=blocks).collect()
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in d.collect())
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        n = [len(s) for s in slots.values()]
        assert max(n) - min(n) <= 1
        again = sharding.shard(d, 7, seed=2, block_rows=blocks).collect()
        assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_uniform(spark):
    d = spark.range(400).repartition(4)
    d = spark.createDataFrame(d.collect()).coalesce(3)
    counts = np.zeros((4, 4))
    for seed in range(12):
        for r in sharding.shard(d, 4, seed=seed, stable=True).collect():
            counts[int(r.id) // 100, r.shard] += 1
    assert abs(counts / 300 - 1).max() < 0.25


def test_edges(spark):
    empty = table(spark, [])
    assert sharding.shard(empty, 3).count() == 0
    d = spark.createDataFrame([(None, 1), (None, 2)], "shard string, cell int")
    got = sharding.shard(d, 4, stable=False)
    assert got.columns == ["cell", "shard", "slot"] and got.count() == 2
