import zlib

import numpy as np
from docs import DOCS, corpus, table
from pyspark.sql import functions as F

from verisift.llm import toxicity

SF = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_recall_and_precision(spark):
    """On sf0.1, with the query's own split: 825 held-out rows, 97 of them toxic, 6 of those without any insult (read by hand)."""
    sf = SF.replace("0.01", "0.1")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    model = toxicity.train(d, spark.createDataFrame(labels[[not held_out(i) for i in labels.doc_id]]))
    test = labels[[held_out(i) for i in labels.doc_id]]
    s = {r.doc_id: r.score for r in toxicity.score(d.where(F.col("doc_id").isin([int(i) for i in test.doc_id])), model).collect()}
    test = test[[i in s for i in test.doc_id]]
    y, x = test.toxic.to_numpy(), np.array([s[i] for i in test.doc_id])
    recall, precision, alarms = (x[y == 1] >= 0.5).mean(), (y[x >= 0.5] == 1).mean(), (x[y == 0] >= 0.5).mean()
    assert recall >= 0.84 and precision >= 0.85 and alarms <= 0.03, (recall, precision, alarms)


def test_features_equal_brute_force():
    """Maxima of every filter at every place, by loops; in pieces as at once."""
    rng = np.random.default_rng(2)
    tables = [[rng.normal(0, 1, (50, 4)).astype(np.float32) for _ in range(w)] for w in (1, 2, 3)]
    m = toxicity.Model(tables, [rng.normal(0, 1, 4).astype(np.float32) for _ in range(3)], rng.normal(0, 1, 12).astype(np.float32), 0.1)
    for n in (0, 1, 2, 3, 40):
        ids = rng.integers(0, 50, n).astype(np.int32)
        want = []
        for places, bias in zip(tables, m.bias):
            x = np.concatenate([ids, np.zeros(max(0, len(places) - n), np.int32)])
            for f in range(4):
                at = [sum(float(places[j][x[i + j], f]) for j in range(len(places))) + float(bias[f]) for i in range(len(x) - len(places) + 1)]
                want.append(max(0.0, *at) if n else 0.0)  # no words: no evidence
        for piece in (7, 1 << 15):
            if n >= 3 or piece > 7:
                assert np.allclose(m.features(ids, piece), want, atol=1e-5)


def test_sample_bounds(spark):
    rows, labels = synthetic()
    d, y = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    small = toxicity.train(d, y, toxicity.Config(sample_bytes=1))  # the first row alone
    assert toxicity.score(d, small).count() == len(rows)


def synthetic(n=300):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        w = [f"v{k}" for k in rng.integers(0, 300, rng.integers(5, 80))]
        bad = i % 5 == 0
        if bad:
            w[rng.integers(len(w))] = ["vile", "nasty"][i % 2]
        rows.append((i, " ".join(w), ["en", "de"][i % 2], "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_learns_and_scores_text_alone(spark):
    rows, labels = synthetic()
    d = table(spark, rows)
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    new = [(1, "v1 v2 Vile v9", "en", "x", 1), (2, "v1 v2 Vile v9", None, None, None), (3, "v1 v2 v3 v9", "zz", "x", 1), (4, None, None, None, None), (5, "", "en", "x", 1), (6, "v7 " * 200_000 + "nasty", "en", "x", 1)]
    got = {r.doc_id: r for r in toxicity.score(table(spark, new), model).collect()}
    assert got[1].score == got[2].score and got[1].score > 0.5 > got[3].score
    assert got[4].score == got[5].score < 0.5 and got[6].score > 0.5
    assert all(0 <= r.score <= 1 and r.threshold is not None and r.toxic_flag is not None for r in got.values())


def test_edges(spark):
    d = spark.createDataFrame(corpus(), DOCS)
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(d, none).where("score > 0.5").count() == 0
    one = toxicity.train(d, spark.createDataFrame([(0, 1, 0), (0, 1, 0), (None, 1, 1), (121, None, None)], "doc_id long, quality int, toxic int"))
    assert toxicity.score(d, one).count() == d.count() and toxicity.score(d.limit(0), one).count() == 0
    assert toxicity.calibrate(np.array([0.9, 0.8, 0.1]), np.array([1.0, 1.0, 0.0]), weight=0) == (0.8 + 0.1) / 2
    assert toxicity.calibrate(np.full(9, 0.3), np.array([1.0] + [0.0] * 8)) == 0.5


def test_rare_words_take_their_prefix():
    texts = [f"mild v{i}" for i in range(40)] + [f"nasty{i}x mild" for i in range(20)]
    model = toxicity.fit(texts, np.array([0.0] * 40 + [1.0] * 20))
    h = toxicity.Hasher(toxicity.Config().buckets, model.kept)
    assert model.score(h("nasty999 mild")) > 0.5 > model.score(h("mild v999"))


def test_words_of_a_small_language_count():
    """Eight texts of 1,208 are less than one in a hundred."""
    rng = np.random.default_rng(5)
    words = lambda k: " ".join(f"v{i}" for i in rng.integers(0, 200, k))
    texts = [words(20) for _ in range(1100)] + [f"{words(5)} nasty {words(5)}" for _ in range(100)] + [f"{words(5)} malvado {words(5)}" for _ in range(8)]
    model = toxicity.fit(texts, np.array([0.0] * 1100 + [1.0] * 108))
    h = toxicity.Hasher(toxicity.Config().buckets, model.kept, model.rare)
    assert h("malvado")[0] != 0 and h("unseen")[0] == 0
    assert model.score(h("v1 malvado v2")) > 2 * model.score(h("v1 v3 v2"))


def test_fit_reads_whole_texts():
    """Labelled for a word after 2,050 others; scanned in pieces as at once."""
    rng = np.random.default_rng(6)
    words = lambda k: " ".join(f"v{i}" for i in rng.integers(0, 50, k))
    texts = [words(2060) for _ in range(150)] + [f"{words(2050)} vile {words(9)}" for _ in range(100)]
    y = np.array([0.0] * 150 + [1.0] * 100)
    for piece in (1 << 15, 700):
        model = toxicity.fit(texts, y, toxicity.Config(widths=(1, 2), piece=piece))
        h = toxicity.Hasher(toxicity.Config().buckets, model.kept, model.rare)
        assert model.score(h("v1 vile v2")) > 0.5 > model.score(h("v1 v3 v2"))


def test_every_labelled_row_counts(spark):
    """A word that only labelled rows behind the first 6,000 by hash hold, learned in four parts, as in one."""
    d = spark.range(6500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("v"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(90))) for k in range(6)]).alias("t"))
    late = {r.doc_id for r in d.orderBy(F.xxhash64("doc_id"), "doc_id").offset(6000).collect()}
    bad = F.col("doc_id").isin(sorted(late)[:160])
    d = d.select("doc_id", F.when(bad, F.concat("t", F.lit(" vile"))).otherwise(F.col("t")).alias("text"), bad.cast("int").alias("toxic")).localCheckpoint()
    for rows in (1 << 14, 1800):
        c = toxicity.Config(part_rows=rows, steps=600)
        model = toxicity.train(d.drop("toxic"), d.select("doc_id", "toxic"), c)
        h = toxicity.Hasher(c.buckets, model.kept, model.rare)
        assert model.score(h("v1 vile v2")) > 0.5 > model.score(h("v1 v3 v2"))
