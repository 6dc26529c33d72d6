"""Toxicity: a convolutional text classifier, trained in numpy.

Words are hashed to rows of an embedding table. Filters of several widths slide over the words, the maximum of each
filter over the whole text is kept, and a logistic unit reads the maxima. Scores depend on the text alone. A filter of
width w is a sum of w per-word terms, so for scoring each (filter, place) is one lookup table ``embedding @ weights``;
a text of any length is scanned in pieces with a running maximum.

Training takes every labelled row, as Spark jobs. Labels meet their documents in parts by id of about ``part_rows`` rows; words and
prefixes are counted in all training texts; each part improves the weights on its own rows, and the weights are averaged after each
round over the parts, a row of the embedding by how often each part touched it. One part is plain training. The driver holds the model
and its vocabulary, which have a fixed size and a proven bound (forms that one training text in ``vocabulary`` holds). Thresholds are
calibrated for each language on labelled rows kept out of the fit, from counts by score; a language with few rows uses the common
threshold. Scoring covers all documents and whole texts; the model is broadcast.

Defined results: null, empty or wordless text scores as a text without evidence; ties and repeated rows score equally;
an empty label set gives a constant score of 0; a language that is null or was never seen uses the common threshold;
extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import may_be_among, pieces, written

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words that a worker remembers; steps of a score in calibration; fraction bits of the sums that average the weights.
MEMORY, STEPS, FRACTION = 200_000, 10_000, 32


@dataclass
class Config:
    buckets: int = 1 << 16
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    epochs: int = 16
    rate: float = 0.02
    least_steps: int = 300  # more epochs for small samples
    decay: float = 1e-3  # at least; 1 / rows for small samples
    batch: int = 32
    seed: int = 7
    sample_bytes: int = 0  # without effect: every labelled row counts
    part_rows: int = 1 << 14  # labelled rows that one task trains on, about
    part_bytes: int = 64 << 20  # and bytes of their texts
    rounds: int = 5  # over all rows at least
    steps: int = 2000  # batches that a part goes through in all rounds, at least
    least_rows: int = 5  # a word or prefix counts if this many training texts hold it
    vocabulary: int = 2000  # and one in so many
    least_share: int = 100  # one in so many texts makes it frequent: words take their own row, rarer ones share rows
    piece: int = 1 << 15  # words of a text scanned at once in the fit


class Hasher:
    """Words -> embedding rows by hash. A word that is not frequent in training (its hash is not in ``kept``) takes the row of
    its longest prefix that is; without one, of its shortest prefix (or itself) in ``rare``; without that it is row 0, as padding."""

    def __init__(self, buckets: int, kept: frozenset[int] | None = None, rare: frozenset[int] = frozenset()):
        self.buckets, self.kept, self.rare, self.known = buckets, kept, rare, {}

    def __call__(self, text: str | bytes | None) -> np.ndarray:
        data = b"" if text is None else text.encode() if isinstance(text, str) else text
        known, n, kept, rare, out = self.known, self.buckets - 1, self.kept, self.rare, []
        for w in WORDS.findall(data.lower()):
            h = known.get(w)
            if h is None:
                if len(known) > MEMORY:
                    known.clear()
                of = forms(w)
                h = next((h for h in of if kept is None or h in kept), None)
                h = next((h for h in reversed(of) if h in rare), None) if h is None else h
                h = known[w] = 0 if h is None else h % n + 1
            out.append(h)
        return np.array(out, np.int32)


def forms(w: bytes) -> list[int]:
    """Hashes of a word and, longest first, of its prefixes of 7 to 4 bytes."""
    return [zlib.crc32(w), *[zlib.crc32(w[:k], 1) for k in range(min(7, len(w)), 3, -1)]]


def frequent(texts: list[str], least: int) -> dict[int, int]:
    """Hashes of the words and prefixes that ``least`` training texts hold, with the number of texts: counted by hash bits
    first, then the likely ones exactly."""
    slots = np.zeros(1 << 22, np.int32)
    for t in texts:
        slots[np.unique(np.fromiter(all_forms(t), np.uint32) & 0x3FFFFF)] += 1
    seen: Counter[int] = Counter()
    for t in texts:
        h = np.unique(np.fromiter(all_forms(t), np.uint32))
        seen.update(h[slots[h & 0x3FFFFF] >= least].tolist())
    return {h: n for h, n in seen.items() if n >= least}


def all_forms(text: str | None) -> Iterator[int]:
    return (h for w in set(WORDS.findall((text or "").encode().lower())) for h in forms(w))


@dataclass
class Model:
    tables: list[list[np.ndarray]]  # for each width, one (buckets, filters) table for each place
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    kept: frozenset[int] = frozenset()
    rare: frozenset[int] = frozenset()
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.5

    def features(self, ids: np.ndarray, piece: int = 1 << 15) -> np.ndarray:
        """Maxima of all filters over the whole text (0 at least, as after a ReLU)."""
        best = [np.zeros(len(b), np.float32) for b in self.bias]
        for a in range(0, len(ids), piece):
            for k, places in enumerate(self.tables):
                part = ids[a : a + piece + len(places) - 1]
                if len(part) < len(places):
                    part = np.pad(part, (0, len(places) - len(part)))
                n = len(part) - len(places) + 1
                z = places[0][part[:n]]
                for j in range(1, len(places)):
                    z = z + places[j][part[j : j + n]]
                best[k] = np.maximum(best[k], z.max(axis=0) + self.bias[k])
        return np.concatenate(best)

    def score(self, ids: np.ndarray) -> float:
        x = float(self.features(ids) @ self.out + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


@dataclass
class Weights:
    emb: np.ndarray
    ws: list[np.ndarray]
    bs: list[np.ndarray]
    out: np.ndarray
    ob: np.ndarray  # one number

    @classmethod
    def drawn(cls, c: Config, rng: np.random.Generator, ones: float, rows: int) -> Weights:
        emb = rng.normal(0, 0.05, (c.buckets, c.dim)).astype(np.float32)
        emb[0] = 0
        ws = [rng.normal(0, 0.4, (w, c.dim, c.filters)).astype(np.float32) for w in c.widths]
        bs = [np.zeros(c.filters, np.float32) for _ in c.widths]
        return cls(emb, ws, bs, rng.normal(0, 0.3, c.filters * len(c.widths)).astype(np.float32), np.array([np.log((ones + 1) / (rows - ones + 1))], np.float32))

    def dense(self) -> list[np.ndarray]:
        return [*self.ws, *self.bs, self.out, self.ob]

    def matrix(self) -> np.ndarray:
        """All numbers in rows as wide as the embedding's, which come first."""
        rest = np.concatenate([x.ravel() for x in self.dense()]).astype(np.float64)
        wide = self.emb.shape[1]
        return np.vstack([self.emb, np.pad(rest, (0, -len(rest) % wide)).reshape(-1, wide)])

    def take(self, m: np.ndarray) -> Weights:
        """Weights of this shape from such a matrix."""
        n, at, new = len(self.emb), 0, []
        rest = m[n:].ravel()
        for x in self.dense():
            new.append(rest[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        k = len(self.ws)
        return Weights(m[:n].astype(np.float32), new[:k], new[k : 2 * k], new[-2], new[-1])

    def model(self, kept: frozenset[int], rare: frozenset[int]) -> Model:
        return Model([[(self.emb @ w[j]).astype(np.float32) for j in range(len(w))] for w in self.ws], self.bs, self.out, float(self.ob[0]), kept, rare)


def vocabulary(seen: dict[int, int], rows: int, c: Config) -> tuple[frozenset[int], frozenset[int]]:
    """Forms with rows of their own, and rarer ones, by the number of training texts that hold them."""
    share, least = max(c.least_rows, rows // c.least_share), least_texts(rows, c)
    kept = frozenset(h for h, n in seen.items() if n >= share)
    return kept, frozenset(h for h, n in seen.items() if n >= least) - kept


def least_texts(rows: int, c: Config) -> int:
    return max(c.least_rows, rows // c.vocabulary)


def rounds_of(rows: float, c: Config) -> int:
    """Passes over a part of so many rows: fewer for larger ones, more for very small ones."""
    return max(c.rounds, min(c.epochs, -(-c.steps * c.batch // max(int(rows), 1))), -(-c.least_steps * c.batch // max(int(rows), 1)))


def fit(texts: list[str], labels: np.ndarray, config: Config = Config()) -> Model:
    """Training on texts at hand: one part, all passes."""
    rng, c = np.random.default_rng(config.seed), config
    kept, rare = vocabulary(frequent(texts, c.least_rows), len(texts), c)
    hasher = Hasher(c.buckets, kept, rare)
    weights, passes = Weights.drawn(c, rng, labels.sum(), len(texts)), rounds_of(len(texts), c)
    improve(weights, [hasher(t) for t in texts], labels, c, rng, range(passes), passes)
    return weights.model(kept, rare)


def improve(weights: Weights, ids: list[np.ndarray], labels: np.ndarray, c: Config, rng: np.random.Generator, epochs: range, of: int) -> np.ndarray:
    """Plain numpy training in place: sparse Adam on the rows of the embedding that a batch touches, dense Adam on the filters.

    epochs: which of the ``of`` passes are made, as the rate falls with them. -> batches that touched each row.
    """
    emb, ws, bs, out, ob = weights.emb, weights.ws, weights.bs, weights.out, weights.ob
    touches = np.zeros(len(emb), np.int64)
    params = [*ws, *bs, out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    em, ev, t = np.zeros_like(emb), np.zeros_like(emb), 0
    mo = vo = 0.0
    for epoch in epochs:
        order, rate = rng.permutation(len(ids)), c.rate * (1 - epoch / of) + 1e-4
        for a in range(0, len(order), c.batch):
            pick, t = order[a : a + c.batch], t + 1
            g = [np.zeros_like(p) for p in params]
            gob, touched, grads = 0.0, [], []
            for i in pick:
                x = ids[i]
                if len(x) < max(c.widths):
                    x = np.pad(x, (0, max(c.widths) - len(x)))
                feats, where = [], []
                for k, w in enumerate(c.widths):
                    top, at = np.full(c.filters, -np.inf, np.float32), np.zeros(c.filters, np.int64)
                    for b in range(0, len(x) - w + 1, c.piece):
                        e = emb[x[b : b + c.piece + w - 1]]
                        n = len(e) - w + 1
                        z = e[:n] @ ws[k][0]
                        for j in range(1, w):
                            z += e[j : j + n] @ ws[k][j]
                        here = z.argmax(axis=0)
                        z = z[here, np.arange(c.filters)]
                        top, at = np.maximum(top, z), np.where(z > top, here + b, at)
                    feats.append(top + bs[k])
                    where.append(at)
                pre = np.concatenate(feats)
                f = np.maximum(pre, 0)
                p = 1 / (1 + np.exp(-np.clip(f @ out + ob[0], -30, 30)))
                d = (p - labels[i]) / len(pick)
                g[-1] += d * f
                gob += d
                df = d * out * (pre > 0)
                for k, w in enumerate(c.widths):
                    dk = df[k * c.filters : (k + 1) * c.filters]
                    g[len(c.widths) + k] += dk
                    for j in range(w):
                        rows = x[where[k] + j]
                        g[k][j] += emb[rows].T * dk
                        touched.append(rows)
                        grads.append(ws[k][j].T * dk[:, None])
            c1, c2, decay = 1 - 0.9**t, 1 - 0.999**t, max(c.decay, 1 / len(ids))
            for q, (p_, g_) in enumerate(zip(params, g)):
                g_ += decay * p_
                m[q] = 0.9 * m[q] + 0.1 * g_
                v[q] = 0.999 * v[q] + 0.001 * g_ * g_
                p_ -= rate * (m[q] / c1) / (np.sqrt(v[q] / c2) + 1e-8)
            mo, vo = 0.9 * mo + 0.1 * gob, 0.999 * vo + 0.001 * gob * gob
            ob[0] -= rate * (mo / c1) / (np.sqrt(vo / c2) + 1e-8)
            rows, inv = np.unique(np.concatenate(touched), return_inverse=True)
            ge = np.zeros((len(rows), c.dim), np.float32)
            np.add.at(ge, inv, np.concatenate(grads))
            ge += decay * emb[rows]
            em[rows] = 0.9 * em[rows] + 0.1 * ge
            ev[rows] = 0.999 * ev[rows] + 0.001 * ge * ge
            emb[rows] -= rate * (em[rows] / c1) / (np.sqrt(ev[rows] / c2) + 1e-8)
            emb[0] = 0
            touches[rows] += 1
    return touches


def calibrate(scores: np.ndarray, labels: np.ndarray, weight: float = 10, rows: np.ndarray | None = None) -> float:
    """The lowest threshold whose F1 is within one in a hundred of the best, in the middle of its gap, drawn to 0.5 by ``weight`` rows of label 1.

    0.5 where a label is missing, or where the best threshold would mark more than twice the rows of label 1.
    rows: where an entry stands for more than one row, their number; ``labels`` are then their sums.
    """
    rows = np.ones(len(scores), np.int64) if rows is None else rows
    if labels.sum() in (0, rows.sum()):
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, y, marked = scores[order], labels[order], np.cumsum(rows[order])
    hits = np.cumsum(y)
    f1 = 2 * hits / (marked + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(np.flatnonzero(f1 >= 0.99 * f1.max())[-1])
    if marked[i] > 2 * y.sum():
        return 0.5
    t = (s[i] + (s[i + 1] if i + 1 < len(s) else 0.0)) / 2
    return float((t * y.sum() + 0.5 * weight) / (y.sum() + weight))


def train(documents: DataFrame, labels: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", least: int = 30) -> Model:
    """Fit on all labelled documents (already without held-out rows)."""
    c, nothing = config, Model([[np.zeros((config.buckets, 1), np.float32)]], [np.zeros(1, np.float32)], np.zeros(1, np.float32), -30.0)
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast(documents.schema[id_col].dataType).alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
    n = picked.count()
    if not n:
        return nothing
    lang = F.col(lang_col) if lang_col in documents.columns else F.lit(None).cast("string")
    docs = may_be_among(documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), lang.alias("_l")), F.col("_id"), picked.select("_id"), n, "_m").where("_m").drop("_m")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0)).alias("b")).first().b
    parts = min(n, max(pieces(n, c.part_rows), pieces(size, c.part_bytes)))
    rows = docs.repartition(parts, "_id").join(picked, "_id").groupBy("_id").agg(F.min(F.struct("_t", "_l", "_y")).alias("r")).select("_id", "r.*")
    texts = rows.withColumn("_c", F.crc32(F.concat(F.lit("calibrate:"), F.col("_id").cast("string")).cast("binary")) % 5 == 0).persist(StorageLevel.DISK_ONLY)
    if texts.count() < 50 or texts.where("_c").isEmpty():
        use, fitted = F.lit(True), F.lit(True)
    else:
        use, fitted = F.col("_c"), ~F.col("_c")
    sums = texts.where(fitted).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("y")).first()
    if not sums.n:
        texts.unpersist()
        return nothing
    seen = form_counts(texts.where(fitted).select("_t"), least_texts(sums.n, c))
    kept, rare = vocabulary(seen, sums.n, c)
    ids = hashed(texts.select("_id", "_l", "_y", use.alias("_use"), fitted.alias("_fit"), "_t"), kept, rare, c).persist(StorageLevel.DISK_ONLY)
    ids.count()
    texts.unpersist()
    model = trained(ids, parts, sums.n, sums.y, c).model(kept, rare)
    scores = written(scored_ids(ids.where("_use"), model, c), "calibration")
    set_thresholds(model, scores, least)
    ids.unpersist()
    return model


def form_counts(texts: DataFrame, least: int) -> dict[int, int]:
    """Hashes of the words and prefixes that ``least`` texts hold, with the number of texts: counted by batches, then summed."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 1000):
                found = [np.unique(np.fromiter(all_forms(t), np.uint32)) for t in f["_t"].iloc[a : a + 1000]]
                h, k = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"h": h.astype(np.int64), "k": k.astype(np.int64)})

    got = texts.mapInPandas(count, "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).where(F.col("k") >= least).toArrow()
    return dict(zip(got.column("h").to_pylist(), got.column("k").to_pylist()))


def narrow(c: Config) -> type:
    """The number type that holds an embedding row's number."""
    return np.uint16 if c.buckets <= 1 << 16 else np.int32


def hashed(texts: DataFrame, kept: frozenset[int], rare: frozenset[int], c: Config) -> DataFrame:
    """Texts -> the numbers of their words' embedding rows, packed."""
    shipped = texts.sparkSession.sparkContext.broadcast((kept, rare))

    @F.pandas_udf("binary")
    def packed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(c.buckets, *shipped.value)
        for s in series:
            yield pd.Series([hasher(t).astype(narrow(c)).tobytes() for t in s], dtype=object)

    return texts.select(*[x for x in texts.columns if x != "_t"], packed("_t").alias("_w"))


def trained(ids: DataFrame, parts: int, rows: int, ones: float, c: Config) -> Weights:
    """Rounds of training in the parts of ``ids``, each followed by an average; one part makes all passes at once."""
    spark, passes = ids.sparkSession, rounds_of(rows / parts, c)
    drawn = np.random.default_rng(c.seed)
    weights = Weights.drawn(c, drawn, ones, rows)
    matrix, wide = weights.matrix(), c.dim
    step = passes if parts == 1 else 1
    mine = ids.where("_fit").select(F.xxhash64("_id").alias("_o"), "_id", "_y", "_w")
    for first in range(0, passes, step):
        shipped = spark.sparkContext.broadcast(weights)

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            held = list(frames)
            if not sum(map(len, held)):
                return
            own = pd.concat(held).sort_values(["_o", "_id"])
            old = shipped.value
            before = old.matrix()
            new, rng = old.take(before), drawn if parts == 1 else np.random.default_rng([c.seed, first, TaskContext.get().partitionId()])
            touches = improve(new, [np.frombuffer(w, narrow(c)) for w in own["_w"]], own["_y"].to_numpy(float), c, rng, range(first, first + step), passes)
            weight = np.concatenate([touches, np.full(len(before) - len(touches), len(own))])
            at = np.flatnonzero(weight)
            moved = np.rint((new.matrix() - before)[at] * weight[at, None] * 2.0**FRACTION).astype(np.int64)  # whole numbers add up alike in any order
            yield pd.DataFrame({"row": at.astype(np.int64), "n": weight[at].astype(np.int64), **{f"d{j}": moved[:, j] for j in range(wide)}})

        moved = mine.mapInPandas(work, ", ".join(["row long", "n long", *[f"d{j} long" for j in range(wide)]]))
        got = moved.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(f"d{j}").alias(f"d{j}") for j in range(wide)]).toArrow().to_pandas()
        matrix[got["row"].to_numpy()] += got[[f"d{j}" for j in range(wide)]].to_numpy(float) / 2.0**FRACTION / got[["n"]].to_numpy(float)
        weights = weights.take(matrix)
        shipped.unpersist()
    return weights


def scored_ids(ids: DataFrame, model: Model, c: Config) -> DataFrame:
    """(lang, label, score) of packed rows."""
    shipped = ids.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(packed: pd.Series) -> pd.Series:
        return pd.Series([shipped.value.score(np.frombuffer(w, narrow(c))) for w in packed], dtype="float64")

    return ids.select("_l", "_y", scored("_w").alias("_s"))


def set_thresholds(model: Model, scores: DataFrame, least: int) -> None:
    """Moves the model's scores so that the common best threshold is 0.5, and sets those of languages with ``least`` rows and one in a thousand."""
    counts = lambda df, *by: df.groupBy(*by, F.round(F.col("_s") * STEPS).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y")).orderBy("b").toArrow().to_pandas()
    common = counts(scores)
    t = float(np.clip(calibrate(common["b"].to_numpy() / STEPS, common["y"].to_numpy(float), rows=common["n"].to_numpy()), 0.02, 0.98))
    model.out_bias -= float(np.log(t / (1 - t)))
    langs = scores.where("_l <> ''").groupBy("_l").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"))
    langs = langs.where((F.col("n") >= max(least, int(common["n"].sum()) // 1000)) & (F.col("y") > 0) & (F.col("y") < F.col("n")))
    for name in sorted(r["_l"] for r in langs.collect()):  # drawn to the common one when there are few rows
        own = counts(scores.where(F.col("_l") == name))
        s = own["b"].to_numpy() / STEPS
        s = 1 / (1 + (1 - s) / np.clip(s, 1e-12, None) * (t / (1 - t)))
        model.thresholds[name] = float(np.clip(calibrate(s, own["y"].to_numpy(float), rows=own["n"].to_numpy()), 0.2, 0.8))


def score(documents: DataFrame, model: Model, config: Config = Config(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Add score (from the text alone), threshold (of the row's language) and toxic_flag (score >= threshold)."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shipped.value
        hasher = Hasher(config.buckets, m.kept, m.rare)
        for s in texts:
            yield pd.Series([m.score(hasher(x)) for x in s], dtype="float64")

    limit = F.lit(model.common)
    if model.thresholds and lang_col in documents.columns:
        known = F.create_map(*[x for k, v in sorted(model.thresholds.items()) for x in (F.lit(k), F.lit(v))])
        limit = F.coalesce(F.when(F.col(lang_col).isNotNull(), F.try_element_at(known, F.coalesce(F.col(lang_col), F.lit("")))), limit)
    return documents.withColumn("score", scored(F.col(text_col))).withColumn("threshold", limit).withColumn("toxic_flag", F.col("score") >= F.col("threshold"))
