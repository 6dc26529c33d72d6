"""Hard-negative mining by angular triangle filtering.

For each anchor and each of its best rows of the same label (positives), the best rows of other labels whose score lies in
a window under the positive's score. Scores are integer inner products of components floor(256 * x).

Method: all rows store their angles to a few reference directions. Sorted by label, nearest reference and angle they are cut
into windows of ``WINDOW_ROWS`` rows, each with the least and greatest angle to every reference and the least and greatest
norm. By the triangle inequality an anchor's angle to any row of a window lies in an interval; its cosines times the norms,
widened by what rounding can cost, bound the score. Only windows whose bounds overlap what an anchor still looks for (its
fifth-best positive so far; the score windows of its positives) are scored, in integers (float64 products below 2**53 are
exact, larger ones are computed in whole numbers).

The anchors are a stated query set. They go in passes of at most ``PASS_BYTES`` of components, each broadcast to the tasks
that read the windows where they stand; a task keeps only its best few rows an anchor, so exchanges hold a few rows for
each anchor and task. No row of the vector table is exchanged more than once, and hot labels or vectors are range-split by a
hash. The reference directions come from a bounded sample (``SAMPLE_ROWS`` rows); they decide speed, never results.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part. Shorter vectors count
as filled up with zeros, an empty one as all zeros. Repeated rows are rows of their own: an anchor row is not its own
positive, a copy of it can be. Ties go to the smaller id, a null id last; a null id is no anchor unless ``anchor`` says so.
A component whose 256-fold is no double
counts as the largest double; scores beyond 64 bits as the largest or smallest such number. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, written

SAMPLE_ROWS = 4096
SAMPLE_NUMBERS = 4_000_000  # components in that sample
REFERENCES = 24
WINDOW_ROWS = 128
PASS_BYTES = 16_000_000
ANGLE_SLACK = 1e-6  # arccos of a rounded cosine is off by 3e-8 at most
EXACT = 2.0**53
BUFFER = 500_000  # candidates before a task cuts them down
PACKED = "first_aid long, n_anchors int, n int, kind string, ids binary, nulls binary, labels binary, anchors binary, rows binary"


@dataclass
class Block:
    """Some rows with whole-number components, their norms and their angles to the references."""

    ids: np.ndarray
    nulls: np.ndarray  # where the id is null
    labels: np.ndarray
    x: np.ndarray  # float64, whole numbers
    norms: np.ndarray
    angles: np.ndarray


def angles_to(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles; what has no direction, or none that can be computed, gets NaN."""
    with np.errstate(all="ignore"):
        norms = np.sqrt((x * x).sum(axis=1))
        return norms, np.arccos(np.clip((x @ refs.T) / norms[:, None], -1, 1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as int64, held within 64 bits."""
    most = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(v) for v in r] for r in b]
    out = [[max(-(1 << 63), min((1 << 63) - 1, sum(p * q for p, q in zip(r, c, strict=True)))) for c in whole] for r in ([int(v) for v in r] for r in a)]
    return np.array(out, np.int64).reshape(len(a), len(b))


def bounds(a: Block, w: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, numbers that no score against a row of the window lies below and above."""
    with np.errstate(all="ignore"):
        known = w.angles[~np.isnan(w.angles).any(axis=1)]
        least, most = (known.min(axis=0) - ANGLE_SLACK, known.max(axis=0) + ANGLE_SLACK) if len(known) else (np.zeros(w.angles.shape[1]), np.full(w.angles.shape[1], np.pi))
        at = np.where(np.isnan(a.angles), 0, a.angles)
        near = np.clip(np.maximum(at - most, least - at).max(axis=1), 0, np.pi)
        far = np.minimum(np.pi, (at + most).min(axis=1))
        blind = np.isnan(a.angles).any(axis=1)
        up, down = np.cos(np.where(blind, 0, near)), np.cos(np.where(blind, np.pi, far))
        small, large = w.norms.min(), w.norms.max()
        slack = a.norms * large * 1e-9 + 1
        high = a.norms * np.where(up >= 0, large, small) * up + slack
        low = a.norms * np.where(down >= 0, small, large) * down - slack
        return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


class Best:
    """The k best rows for each of n searches: higher scores first, ties by id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.parts, self.fresh, self.added = k, np.full(n, np.iinfo(np.int64).min), [], 0, 0

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Rows are cut down once enough new ones stand, and early on, so that what is looked for soon gets narrow."""
        self.parts.append((search, score, ids, nulls))
        self.fresh, self.added = self.fresh + len(search), self.added + 1
        if self.fresh > BUFFER or self.added in (1, 4, 16):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        search, score, ids, nulls = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, nulls, ~score, search))
        search, score, ids, nulls = search[order], score[order], ids[order], nulls[order]
        first = np.searchsorted(search, search)
        place = np.arange(len(search)) - first
        keep, full = place < self.k, place == self.k - 1
        self.least[search[full]] = np.maximum(self.least[search[full]], score[full])
        kept = search[keep], score[keep], ids[keep], nulls[keep]
        self.parts, self.fresh = [kept], 0
        return kept


# ---------------------------------------------------------------- the table of windows


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column -> float64 rows of ``dim`` components, shorter ones filled with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dim).all():
        return values.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(256.0 * _matrix(column, dim))
    big = np.finfo(np.float64).max
    return np.clip(x, -big, big)


def references(rows: DataFrame, dim: int) -> np.ndarray:
    """Unit vectors: spherical k-means over a bounded sample that a hash of the id picks."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, dim)))
    got = [r.vec for r in rows.orderBy(F.xxhash64("id"), "id").select("vec").limit(most).collect()]
    x = _whole(pa.array(got, pa.list_(pa.float64())), dim)
    with np.errstate(all="ignore"):
        norms = np.sqrt((x * x).sum(axis=1))
        x = x[np.isfinite(norms) & (norms > 0)] / norms[np.isfinite(norms) & (norms > 0)][:, None]
    if not len(x):
        return np.eye(1, dim)
    centres = x[np.random.default_rng(12).permutation(len(x))[:REFERENCES]].copy()
    for _ in range(6):
        own, sums = (x @ centres.T).argmax(axis=1), np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres[size > 0] = sums[size > 0] / size[size > 0][:, None]
    return centres


def pack(rows: DataFrame, refs: np.ndarray, dim: int) -> DataFrame:
    """Rows (id, label, anchor, vec) as windows, sorted by label, nearest reference and angle, with the anchors numbered."""
    shipped = rows.sparkSession.sparkContext.broadcast(refs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, at = angles_to(_whole(b.column("vec"), dim), shipped.value)
            at = np.where(np.isnan(at), np.pi, at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.argmin(axis=1).astype(np.int32)), pa.array(at.min(axis=1))], names=[*b.schema.names, "ref", "angle"])

    near = rows.mapInArrow(place, "id long, label long, anchor boolean, vec array<double>, ref int, angle double")
    order = ["label", "ref", "angle", F.xxhash64("id"), "id"]
    near = near.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aid = None
        for b in batches:
            aid = (b.column("part")[0].as_py() << 33) if aid is None and len(b) else aid
            x, ids = _whole(b.column("vec"), dim), b.column("id")
            nulls, chosen = ids.is_null().to_numpy(zero_copy_only=False), b.column("anchor").to_numpy(zero_copy_only=False).astype(bool)
            ids, labels = ids.fill_null(0).to_numpy(), b.column("label").to_numpy()
            out = []
            for i in range(0, len(x), WINDOW_ROWS):
                own = slice(i, i + WINDOW_ROWS)
                top, n = np.abs(x[own]).max(initial=0.0), int(chosen[own].sum())
                kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
                out.append((aid, n, len(x[own]), kind, ids[own].tobytes(), nulls[own].tobytes(), labels[own].tobytes(), chosen[own].tobytes(), x[own].astype(kind).tobytes()))
                aid += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 5), strict=True)], names=[f.split()[0] for f in PACKED.split(", ")]) if out else pa.RecordBatch.from_pylist([], pa.schema([]))

    return near.mapInArrow(cut, PACKED)


def _windows(b: pa.RecordBatch, refs: np.ndarray, dim: int) -> Iterator[tuple[int, np.ndarray, Block]]:
    """Each window of a batch: its first anchor's number, which rows are anchors, and the rows."""
    for w in b.to_pylist():
        x = np.frombuffer(w["rows"], w["kind"]).reshape(w["n"], dim).astype(np.float64)
        ids, nulls, labels, chosen = (np.frombuffer(w[c], t) for c, t in (("ids", np.int64), ("nulls", bool), ("labels", np.int64), ("anchors", bool)))
        yield w["first_aid"], chosen, Block(ids, nulls, labels, x, *angles_to(x, refs))


# ---------------------------------------------------------------- a pass


def _self(first: int, chosen: np.ndarray) -> np.ndarray:
    """For each row of a window its anchor number, or -1."""
    return np.where(chosen, first + np.cumsum(chosen) - 1, -1)


def _positives(windows: DataFrame, shipped, refs, dim: int, k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aids, a = shipped.value
        best = Best(len(aids), k)
        for b in batches:
            for first, chosen, w in _windows(b, refs.value, dim):
                _, high = bounds(a, w)
                # int64 against float64: compared as floats, and the slack is wider than that rounding
                open_ = np.flatnonzero((a.labels >= w.labels.min()) & (a.labels <= w.labels.max()) & (high >= best.least.astype(np.float64) * (1 - 1e-15)))
                if not len(open_):
                    continue
                s = products(a.x[open_], w.x)
                fits = (a.labels[open_][:, None] == w.labels) & (aids[open_][:, None] != _self(first, chosen)) & (s >= best.least[open_][:, None])
                i, j = np.nonzero(fits)
                if len(i):
                    best.add(open_[i], s[i, j], w.ids[j], w.nulls[j])
        at, score, ids, nulls = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(aids[at] if len(at) else np.zeros(0, np.int64)), pa.array(score), pa.array(ids, mask=nulls)], names=["aid", "score", "id"])

    got = windows.mapInArrow(search, "aid long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("aid").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return got.withColumn("slot", rank).where(F.col("slot") <= k)


def _negatives(windows: DataFrame, shipped, refs, dim: int, k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aids, a, positives, of, low, high, score, slots = shipped.value
        best = Best(len(of), k)
        best.least = low.copy()
        for b in batches:
            for _, _, w in _windows(b, refs.value, dim):
                under, over = bounds(a, w)
                live = (over[of] >= best.least.astype(np.float64)) & (under[of] <= high.astype(np.float64))
                if w.labels.min() == w.labels.max():
                    live &= a.labels[of] != w.labels[0]
                searches = np.flatnonzero(live)
                if not len(searches):
                    continue
                open_, back = np.unique(of[searches], return_inverse=True)
                s = np.where(a.labels[open_][:, None] != w.labels, products(a.x[open_], w.x), np.iinfo(np.int64).min)
                for part in np.array_split(np.arange(len(searches)), max(1, len(searches) // 20_000)):
                    own = s[back[part]]
                    i, j = np.nonzero((own >= best.least[searches[part]][:, None]) & (own <= high[searches[part]][:, None]) & (own > np.iinfo(np.int64).min))
                    if len(i):
                        best.add(searches[part][i], own[i, j], w.ids[j], w.nulls[j])
        at, got, ids, nulls = best.cut()
        names = ["aid", "slot", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"]
        own = of[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(aids[own]), pa.array(slots[at]), pa.array(a.ids[own], mask=a.nulls[own]), pa.array(positives[0][at], mask=positives[1][at]), pa.array(score[at]), pa.array(got), pa.array(ids, mask=nulls)], names=names,
        )

    got = windows.mapInArrow(search, "aid long, slot long, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    rank = F.row_number().over(Window.partitionBy("aid", "slot").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _passes(windows: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of anchor numbers with at most ``most`` anchors each; one number a partition comes to the driver."""
    parts = windows.groupBy(F.shiftright("first_aid", 33).alias("p")).agg(F.sum("n_anchors").alias("n")).where("n > 0").orderBy("p").collect()
    out, room = [], 0
    for r in parts:
        at, end = r.p << 33, (r.p << 33) + r.n
        while at < end:
            if not room:
                out.append([at, at])
                room = most
            step = min(room, end - at)
            at, room = at + step, room - step
            out[-1][1] = at
    return [tuple(x) for x in out]


def _anchors(windows: DataFrame, refs, dim: int, lo: int, hi: int) -> tuple[np.ndarray, Block]:
    """The anchors numbered from ``lo`` to before ``hi``."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, chosen, w in _windows(b, refs.value, dim):
                aid = _self(first, chosen)
                own = np.flatnonzero((aid >= lo) & (aid < hi))
                yield pa.RecordBatch.from_arrays([pa.array(aid[own]), pa.array(w.ids[own]), pa.array(w.nulls[own]), pa.array(w.labels[own]), pa.array([w.x[i].tobytes() for i in own], pa.binary())], names=["aid", "id", "nul", "label", "x"])

    reach = windows.where((F.col("n_anchors") > 0) & (F.col("first_aid") < hi) & (F.col("first_aid") + F.col("n_anchors") > lo))
    got = reach.mapInArrow(pick, "aid long, id long, nul boolean, label long, x binary").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float64).reshape(len(got), dim)
    col = lambda c, t: np.array([r[c] for r in got], t)
    return col("aid", np.int64), Block(col("id", np.int64), col("nul", bool), col("label", np.int64), x, *angles_to(x, refs.value))


def mine(
    vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` and ``label`` are columns of ``vectors``; negatives score from ``low`` to ``high`` hundredths of the positive's score.
    """
    spark, vec = vectors.sparkSession, F.transform(vec_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vec.alias("vec"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    dim = max(1, rows.agg(F.max(F.size("vec"))).first()[0] or 0)
    refs = references(rows, dim)
    windows = written(pack(rows, refs, dim), "windows")
    shipped_refs = spark.sparkContext.broadcast(refs)
    folder, parts = shared_folder(spark, "negatives"), []
    types = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for lo, hi in _passes(windows, max(1, PASS_BYTES // (8 * dim))):
        aids, a = _anchors(windows, shipped_refs, dim, lo, hi)
        found = _positives(windows, spark.sparkContext.broadcast((aids, a)), shipped_refs, dim, positives).collect()
        place = {int(x): i for i, x in enumerate(aids)}
        wanted = [(place[r.aid], r.slot, r.id, r.score, -((-low * r.score) // 100), high * r.score // 100) for r in found]
        wanted = [w for w in wanted if w[4] <= w[5]]
        if not wanted:
            continue
        of, slots, ids, score, least, most = zip(*wanted, strict=True)
        whole = lambda x: np.array(x, np.int64)
        named = (whole([i or 0 for i in ids]), np.array([i is None for i in ids], bool))
        shipped = spark.sparkContext.broadcast((aids, a, named, whole(of), whole(least), whole(most), whole(score), whole(slots)))
        parts.append(f"{folder}/{len(parts)}")
        _negatives(windows, shipped, shipped_refs, dim, negatives).write.parquet(parts[-1])
    return spark.read.schema(types).parquet(*parts) if parts else spark.createDataFrame([], types)
