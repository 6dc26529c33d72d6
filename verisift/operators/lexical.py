"""Text and vector retrieval over tables: BM25 through an inverted index, exact and hashed nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import checkpointed, shared_folder
from ..plans.schemas import EVIDENCE
from .retrieve import evidence, top_k

#: BM25 constants. Fixed values.
K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Query words that are broadcast to the documents; of more, the words and their documents meet by a shuffle.
FEW_WORDS = 200_000


def postings(documents: DataFrame, key: str, column: str, asked: DataFrame) -> DataFrame:
    """(token, key, tf, length) of the queries' tokens alone, dealt by document, so that a document's scores are summed where it lies."""
    rows = documents.select(key, tokens(F.col(column)).alias("_t")).select(key, F.size("_t").alias("length"), F.explode_outer("_t").alias("token"))
    wanted = rows.where("token IS NOT NULL").join(asked.select("token").distinct(), "token", "left_semi")
    return wanted.repartition(key).groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def weighed(asked: DataFrame, documents: DataFrame, query_key: str, key: str, column: str, boost: float) -> DataFrame:
    """(query, document, score) by one field. Only the queries' tokens are kept of the index."""
    few = asked.limit(FEW_WORDS + 1).count() <= FEW_WORDS
    asked = F.broadcast(asked) if few else asked
    wanted = postings(documents, key, column, asked)
    wanted = wanted if few else checkpointed(wanted)  # a checkpoint would not keep where the documents lie
    df = wanted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    s = documents.select(F.size(tokens(F.col(column))).alias("n")).agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("avgdl")).first()  # two numbers
    n, avg = float(s.n), float(s.avgdl or 1.0) or 1.0
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(avg)))
    words = asked.join(df.select("token", idf.alias("idf")), "token")
    words = F.broadcast(checkpointed(words)) if few else words
    return wanted.join(words, "token").select(query_key, key, part.alias("w")).groupBy(query_key, key).agg((F.sum("w") * boost).alias("score"))


def asked_tokens(queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    return queries.select(query_key, F.explode_outer(tokens(F.col(query_text))).alias("token")).where("token IS NOT NULL")  # repeated query words count again


def bm25(queries: DataFrame, documents: DataFrame, query_key: str, query_text: str, key: str, text: str, boost: float = 1.0) -> DataFrame:
    """(query, document, score) for all pairs that share a token."""
    return weighed(asked_tokens(queries, query_key, query_text), documents, query_key, key, text, boost)


def best_of(queries: DataFrame, spans: DataFrame, fields: dict[str, float], query_key: str = "query_id", query_text: str = "query", key: str = "span_id") -> DataFrame:
    """The best score over several fields, each with its own statistics and boost."""
    asked = asked_tokens(queries, query_key, query_text)
    scored = [weighed(asked, spans, query_key, key, field, boost) for field, boost in fields.items()]
    return reduce(DataFrame.unionByName, scored).groupBy(query_key, key).agg(F.max("score").alias("score"))


def search(queries: DataFrame, spans: DataFrame, k: int = 20, fields: dict[str, float] | None = None, query_key: str = "query_id", query_text: str = "query", filters: dict | None = None) -> DataFrame:
    """Best-of-fields search with term filters; an empty query returns everything with score 1; top k a query."""
    for c, v in (filters or {}).items():
        if v is not None:
            spans = spans.where(F.col(c) == v)
    asked = queries.where(F.size(tokens(F.col(query_text))) > 0)
    best = best_of(asked, spans, fields or {"text": 2.0, "normalized_text": 1.0}, query_key, query_text)
    best = top_k(best, [query_key], [F.col("score").desc(), F.col("span_id")], k)
    empty = queries.where(F.size(tokens(F.col(query_text))) == 0).select(query_key)
    if empty.take(1):  # each such query gets the same first k spans: k ids
        first = [r.span_id for r in spans.select("span_id").orderBy("span_id").limit(k).collect()]
        if first:
            best = best.unionByName(empty.select(query_key, F.explode(F.array(*[F.lit(x) for x in first])).alias("span_id"), F.lit(1.0).alias("score")))
    return best.join(spans, "span_id")


def text_evidence(hits: DataFrame, claim_key: str = "query_id") -> DataFrame:
    """Hits -> rows of the evidence schema (tier 2 and score 0 where missing); columns it does not know stay as properties."""
    known = {f.name for f in EVIDENCE.fields} | {claim_key}
    rest = [c for c in hits.columns if c not in known]
    properties = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    h = hits.withColumn("claim_id", F.col(claim_key))
    return evidence(
        h, "text", {}, kind=F.lit("text"), properties=properties, span_id=F.coalesce(F.col("span_id"), F.col("document_id")), document_id=F.col("document_id"), text=F.col("text"), captured_at=F.col("captured_at"),
        source_tier=F.coalesce(F.col("source_tier"), F.lit(2)), score=F.coalesce(F.col("score"), F.lit(0.0)), source_document_ids=F.when(F.col("document_id").isNotNull(), F.array("document_id")).otherwise(F.array().cast("array<string>")),
    )


def embedded(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], name: str = "embedding") -> DataFrame:
    """Adds a vector of each text by a user's function over a batch of texts (null text: null)."""

    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        have = s.notna()
        out = pd.Series([None] * len(s), dtype=object)
        got = embedder(list(s[have])) if have.any() else []
        for i, v in zip(np.flatnonzero(have), got):
            out.iloc[i] = [float(x) for x in v]
        return out

    return df.withColumn(name, vectors(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


class Best:
    """The k best rows of each query so far: by score, then by key."""

    def __init__(self, k: int, queries: int, keys: np.ndarray):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.at, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), keys[:0]

    def add(self, scores: np.ndarray, keys: np.ndarray, own: np.ndarray) -> None:
        """scores: a row a query; own: the queries' keys, as no row is its own neighbour."""
        at, j = np.nonzero(scores >= self.least[:, None])
        other = own[at] != keys[j]
        at, j = at[other], j[other]
        at, score, key = np.concatenate([self.at, at]), np.concatenate([self.score, scores[at, j]]), np.concatenate([self.key, keys[j]])
        order = np.lexsort((key, -score, at))
        at, score, key = at[order], score[order], key[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.least[at[place == self.k - 1]] = score[place == self.k - 1]
        self.at, self.score, self.key = at[place < self.k], score[place < self.k], key[place < self.k]


#: Scores made at once by a task.
SCORES_AT_ONCE = 4_000_000


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id", vec: str = "embedding", most_queries: int = 10_000, digits: int = 12) -> DataFrame:
    """Cosine neighbours of a stated query set against all rows, by score to ``digits`` places, then by key.

    The queries, whose number is checked against ``most_queries``, are shipped to every task, which multiplies its rows with them
    in blocks and keeps the k best rows a query; a larger set is split by hash into as many passes as it needs.
    """
    passes, out = max(1, math.ceil(queries.count() / most_queries)), None
    rows = vectors.where(norm(F.col(vec)) > 0).select(key, vec)
    types = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    for i in range(passes):
        part = (queries if passes == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(passes)) == i)).where(norm(F.col(vec)) > 0).select(query_key, vec).collect()
        shipped = vectors.sparkSession.sparkContext.broadcast(([r[query_key] for r in part], [np.asarray(r[vec], np.float64) for r in part]))

        def compare(frames: Iterator[pd.DataFrame], shipped: Broadcast = shipped) -> Iterator[pd.DataFrame]:
            ids, asked = shipped.value
            best: dict[int, tuple[np.ndarray, np.ndarray, Best]] = {}  # by the number of components
            for frame in frames:
                sizes = frame[vec].map(len).to_numpy()
                for d in np.unique(sizes):
                    mine = [n for n, v in enumerate(asked) if len(v) == d]
                    if not mine:
                        continue
                    keys = frame[key].to_numpy()[sizes == d]
                    if d not in best:
                        q = np.array([asked[n] for n in mine])
                        best[d] = np.array([ids[n] for n in mine], keys.dtype), q / np.linalg.norm(q, axis=1, keepdims=True), Best(k, len(mine), keys)
                    own, q, top = best[d]
                    x = np.array([np.asarray(v, np.float64) for v in frame[vec][sizes == d]])
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    step = max(1, SCORES_AT_ONCE // len(mine))
                    for a in range(0, len(x), step):
                        top.add(np.nan_to_num(np.round(q @ x[a : a + step].T, digits), nan=np.inf), keys[a : a + step], own)
            for own, _, top in best.values():
                yield pd.DataFrame({query_key: own[top.at], key: top.key, "score": np.where(np.isinf(top.score), np.nan, top.score)})

        got = top_k(rows.mapInPandas(compare, types), [query_key], [F.col("score").desc(), F.col(key)], k, rank="rank")
        out = got if out is None else out.unionByName(got)
    return out


#: The index is fitted on at most so many rows, and so many numbers, of a sample by hash.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 8_000_000


@dataclass(frozen=True)
class Lists:
    """Unit centres; a vector belongs to the list of the centre it is nearest to."""

    centres: np.ndarray
    probes: int  # lists a query looks into

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(axis=1)

    def near(self, x: np.ndarray) -> np.ndarray:
        """For each query, which lists it looks into."""
        out = np.zeros((len(x), len(self.centres)), bool)
        best = np.argpartition(-(x @ self.centres.T), self.probes - 1, axis=1)[:, : self.probes]
        out[np.arange(len(x))[:, None], best] = True
        return out


def unit(vectors: list | pd.Series) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0), np.float32)
    x = np.array([np.asarray(v, np.float32) for v in vectors], np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def fit_lists(vectors: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", recall: float = 0.97, seed: int = 1) -> Lists:
    """Centres by spherical k-means over a bounded sample, and as many probes as the sample's own neighbours need for the recall."""
    first = vectors.select(F.size(vec).alias("d")).where("d > 0").first()
    if first is None:
        return Lists(np.ones((1, 1), np.float32), 1)
    most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // first.d))
    got = vectors.select(key, vec).where(norm(F.col(vec)) > 0).orderBy(F.xxhash64(key), key).limit(most).collect()
    x, rng = unit([r[vec] for r in got]), np.random.default_rng(seed)
    if not len(x):
        return Lists(np.ones((1, first.d), np.float32), 1)
    centres = x[rng.permutation(len(x))[: max(1, math.ceil(math.sqrt(len(x))))]].copy()
    for _ in range(8):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=len(centres)) > 0
        centres[full] = sums[full] / np.maximum(np.linalg.norm(sums[full], axis=1, keepdims=True), 1e-30)
    # where the true neighbours of some sample rows lie in their order of lists
    asked = x[:: max(1, len(x) // 300)]
    scores = asked @ x.T
    near = np.argpartition(-scores, min(k, len(x) - 1), axis=1)[:, : k + 1]
    own, order = (x @ centres.T).argmax(axis=1), np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
    return Lists(centres, int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1)


def index_vectors(vectors: DataFrame, lists: Lists, path: str, vec: str = "embedding") -> DataFrame:
    """Every row with its list, written by list, so that a search reads only the lists it looks into."""
    shipped = vectors.sparkSession.sparkContext.broadcast(lists)

    @F.pandas_udf("int")
    def own(v: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.of(unit(v)).astype("int32"))

    rows = vectors.where(norm(F.col(vec)) > 0).withColumn("list", own(F.col(vec)))
    rows.write.partitionBy("list").parquet(path)
    return vectors.sparkSession.read.schema(rows.schema).parquet(path)


def knn_hashed(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id", vec: str = "embedding", most_queries: int = 10_000, recall: float = 0.97) -> DataFrame:
    """Approximate cosine neighbours: vectors are hashed to the nearest of a sample's centres, a query looks into the
    lists of its nearest centres, and what lies there is scored exactly.

    All rows are indexed. The queries are a stated set, shipped in blocks of a checked size to the lists, which stay where
    they are, so a list that holds a third of the rows is read in as many tasks as it has parts.
    """
    lists = fit_lists(vectors, k, key, vec, recall)
    table = index_vectors(vectors.select(key, vec), lists, shared_folder(vectors.sparkSession, "lists"), vec)
    n = queries.count()
    passes, out = max(1, math.ceil(n / most_queries)), None
    types = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    for i in range(passes):
        part = (queries if passes == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(passes)) == i)).where(norm(F.col(vec)) > 0).select(query_key, vec).collect()
        q = unit([r[vec] for r in part])
        fits = len(part) and q.shape[1] == lists.centres.shape[1]  # not so for an empty table
        looks = lists.near(q) if fits else np.zeros((len(part), len(lists.centres)), bool)
        shipped = vectors.sparkSession.sparkContext.broadcast(([r[query_key] for r in part], q, looks))

        def compare(frames: Iterator[pd.DataFrame], shipped: Broadcast = shipped) -> Iterator[pd.DataFrame]:
            ids, q, looks = shipped.value
            for frame in frames:
                for number, rows in frame.groupby("list"):
                    asked = np.flatnonzero(looks[:, int(number)])
                    if not len(asked):
                        continue
                    own = rows[key].to_numpy()
                    s = q[asked].astype(np.float64) @ unit(rows[vec]).astype(np.float64).T
                    s[np.equal.outer(np.array([ids[a] for a in asked], dtype=object), own.astype(object))] = -np.inf  # not its own neighbour
                    best = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]  # more cannot be among the k nearest
                    out = [(ids[a], own[j], float(s[r, j])) for r, a in enumerate(asked) for j in best[r] if np.isfinite(s[r, j])]
                    yield pd.DataFrame({c: pd.Series([x[m] for x in out], dtype=object) for m, c in enumerate((query_key, key, "score"))})

        used = [int(x) for x in np.flatnonzero(looks.any(axis=0))]
        got = table.where(F.col("list").isin(used)).mapInPandas(compare, types) if used else vectors.sparkSession.createDataFrame([], types)
        got = top_k(got, [query_key], [F.col("score").desc(), F.col(key)], k, rank="rank")
        out = got if out is None else out.unionByName(got)
    return out
