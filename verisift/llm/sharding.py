"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The input's partitions hold n_1 .. n_P rows; the shards, cut into blocks of about ``block_rows`` rows, are the cells.
How many rows each partition sends to each cell follows the multivariate hypergeometric law. Row p of that matrix is
drawn inside the task of partition p, without the rest of the matrix: the partitions are the leaves of a binary tree,
and the draw walks from the root to the leaf, splitting the cell totals between the two halves at each node with a
generator seeded by (seed, node). Tasks that share a node draw the same split, so the columns add up to the cell sizes
exactly. Then each partition permutes its rows (a seeded permutation of cell labels), rows are exchanged by cell, and
each cell is permuted again by a seeded key. Only the partition sizes (one number each) pass the driver.

Law kept: ``rows`` - shard sizes differ by one row at most. Any row is equally likely to be at any slot of any shard.
A cell is a partition of its own and holds at most ``block_rows`` rows, whatever the keys of the input, so no key, source
or group of equal texts can make a task large. The law is exact at any size: beyond 10**9 rows the draws come from a
rejection sampler in multiple precision.

Defined results: rows are placed by position, so null columns, empty or long texts and repeated rows need no rule;
shards of an empty table are empty; columns of the input pass through. The input must give the same rows in the same
partitions when a task runs again, as a file scan does; pass ``stable=False`` for other plans, which are checkpointed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, own_names


def cell_sizes(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard of each cell, first slot of each cell, rows of each cell); shards differ by one row at most, so do a shard's cells."""
    per = np.full(shards, rows // shards, np.int64)
    per[: rows % shards] += 1
    blocks = np.maximum(1, -(-per // block_rows))
    shard = np.repeat(np.arange(shards), blocks)
    k = np.arange(len(shard)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    b, n = blocks[shard], per[shard]
    first = k * (n // b) + np.minimum(k, n % b)
    return shard, first, n // b + (k < n % b)


def matrix_row(sizes: np.ndarray, cells: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix: how many rows of partition p go to each cell."""
    lo, hi, node, have = 0, len(sizes), 1, cells.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = hypergeometric(np.random.default_rng([seed, node]), have, int(sizes[lo:mid].sum()))
        if p < mid:
            have, hi, node = left, mid, 2 * node
        else:
            have, lo, node = have - left, mid, 2 * node + 1
    return have


def hypergeometric(rng: np.random.Generator, cells: np.ndarray, n: int) -> np.ndarray:
    """n draws without replacement from cells of these sizes, by halving (numpy's own multivariate draw stops at 10**9)."""
    if len(cells) == 1:
        return np.array([n], np.int64)
    mid = len(cells) // 2
    a, b = int(cells[:mid].sum()), int(cells[mid:].sum())
    if a + b < 10**9:
        return rng.multivariate_hypergeometric(cells, n, method="marginals")
    left = _binary(rng, a, b, n)
    return np.concatenate([hypergeometric(rng, cells[:mid], left), hypergeometric(rng, cells[mid:], n - left)])


def _binary(rng: np.random.Generator, a: int, b: int, n: int, most: int = 10**9) -> int:
    """Of n draws without replacement from a + b, how many are of the a.

    Beyond the range of numpy's sampler by rejection from the envelope that holds for any log-concave law (a flat middle
    and exponential tails around the mode; Devroye 1987), with probabilities in ``DIGITS`` decimal digits.
    """
    if a + b < most:
        return int(rng.hypergeometric(a, b, n))
    lo, hi = max(0, n - b), min(a, n)
    if lo == hi:
        return lo
    with localcontext() as c:
        c.prec = DIGITS
        log_p = lambda k: log_choose(a, k) + log_choose(b, n - k)
        mode = min(hi, max(lo, (n + 1) * (a + 1) // (a + b + 2)))
        top = log_p(mode)
        p = float((top - log_choose(a + b, n)).exp())
        w = 1 + p / 2
        while True:
            u, v, x = rng.random(), 1 - rng.random(), 1 - rng.random()
            y = v * w / p if u <= w / (1 + w) else (w - math.log(v)) / p
            k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
            if lo <= k <= hi and Decimal(x).ln() + Decimal(min(0.0, w - p * y)) <= log_p(k) - top:
                return k


#: Digits of a probability's logarithm; terms of Stirling's series used (Bernoulli numbers as fractions, fixed values).
DIGITS, STIRLING = 50, ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400))
TWO_PI = Decimal("6.28318530717958647692528676655900576839433879875021164194989")


def log_factorial(n: int) -> Decimal:
    """By the sum of logarithms for small numbers, by Stirling's series (an error below 1e-40) from 1,000 on."""
    if n < 1000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    out = x * x.ln() - x + (TWO_PI * x).ln() / 2
    for i, (top, bottom) in enumerate(STIRLING):
        out += Decimal(top) / (bottom * x ** (2 * i + 1))
    return out


def log_choose(n: int, k: int) -> Decimal:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def shard(df: DataFrame, shards: int, seed: int = 0, block_rows: int = 8192, stable: bool = True) -> DataFrame:
    """Add ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0 in each shard)."""
    if not stable:
        df = checkpointed(df)
    counted = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = np.zeros(max((r.p for r in counted), default=0) + 1, np.int64)
    for r in counted:
        sizes[r.p] = r.n
    of, first, cells = cell_sizes(int(sizes.sum()), shards, block_rows)
    names = own_names(df, "cell", "key", "first", "shard", "slot")
    cell, key = names["cell"], names["key"]
    schema = T.StructType([*df.schema.fields, T.StructField(cell, T.IntegerType()), T.StructField(key, T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        n = int(sizes[p]) if p < len(sizes) else 0
        rng = np.random.default_rng([seed, 0, p])
        to = rng.permutation(np.repeat(np.arange(len(cells), dtype=np.int32), matrix_row(sizes, cells, p, seed))) if n else np.zeros(0, np.int32)
        at = 0
        for batch in batches:
            k = batch.num_rows
            if at + k > n:
                raise ValueError(f"partition {p} has more than the {n} rows it was counted with; pass stable=False")
            keys = rng.integers(-(2**62), 2**62, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[at : at + k], pa.int32()), pa.array(keys, pa.int64())], names=[*batch.schema.names, cell, key])
            at += k
        if at != n:
            raise ValueError(f"partition {p} has {at} rows and was counted with {n}; pass stable=False")

    # cell i is partition i; inside it rows go by their key (equal keys, about one cell in 10**11, by their order of arrival)
    dealt = df.mapInArrow(deal, schema).repartitionById(max(1, len(cells)), F.col(cell))
    ranked = dealt.withColumn(key, F.row_number().over(Window.partitionBy(cell).orderBy(key)).cast("long") - 1)
    s, f = place(F.col(cell), int(sizes.sum()), shards, block_rows)
    out = ranked.withColumns({names["shard"]: s.cast("int"), names["slot"]: (f + F.col(key)).cast("long")}).drop(cell, key, "shard", "slot")
    return out.withColumnsRenamed({names["shard"]: "shard", names["slot"]: "slot"})


def place(cell, rows: int, shards: int, block_rows: int):
    """Shard and first slot of a cell: shards with one row more come first, so two kinds of shard exist."""
    low, more = divmod(rows, shards)
    b1, b0 = max(1, -(-(low + 1) // block_rows)), max(1, -(-low // block_rows))
    big = cell < more * b1
    s = F.when(big, F.floor(cell / b1)).otherwise(more + F.floor((cell - more * b1) / b0))
    k = F.when(big, cell % b1).otherwise((cell - more * b1) % b0)
    n, b = F.when(big, low + 1).otherwise(low), F.when(big, b1).otherwise(b0)
    return s, k * F.floor(n / b) + F.least(k, n % b)
