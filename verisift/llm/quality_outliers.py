"""Quality rules with robust multivariate outliers: minimum-covariance-determinant (MCD) estimates per language and source.

A text is measured in one row expression (words, characters, symbols, repeated lines, words in repeated 3-word windows).
Base rules reject short and repetitive texts. What passes becomes a vector of five transformed statistics, in whole 128ths,
and is rejected when its robust Mahalanobis distance within its language and source is too large.

MCD by deterministic starts: quantile spreads without correlation, the correlation of tanh scores, and the spatial-sign
covariance. From each, concentration steps take the half of the vectors nearest by the current estimate and
estimate anew; after two steps the start with the least determinant goes on until nothing changes. Then one reweighting
step, as in FAST-MCD; both scatters are scaled so that the median distance is that of the normal law, but never down.

All of it is DataFrame code over whole tables, without Python on the executors. Texts are read once and never exchanged; what is
exchanged is a few numbers a document, and a few sums for each group, start and task. A step finds the middle of
each group's distances from counts by bucket (64 to a doubling; what shares the last bucket is in), so no group is ever
sorted or gathered. Sums are of whole numbers, so results do not depend on partitioning. Estimates are broadcast only while
there are at most ``FEW_GROUPS`` groups; beyond that they are joined.

Choices: equal measurements in one language and source count once in an estimate, so that copies cannot take it over (they are all
judged). A language and source with fewer than ``LEAST_ROWS`` such vectors is estimated with its language's other small
sources, and if those are too few, with all such rest. A fixed least spread for each statistic is added to every covariance, so
constant statistics leave room for rare harmless values.

Defined cases: a null text has no words and fails the base rules. Null languages and sources are groups of their own.
Repeated rows are judged alike. Words are runs without space, tab, LF, VT, FF, CR; a line without a word is no duplicate.
Windows are compared by 64-bit hashes. An empty table gives none. Other columns are kept; helper names give way to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_names, shared_folder, written

SCALE = 128  # steps of a transformed statistic
SPREAD = (0.25, 0.05, 0.1, 0.2, 0.2)  # least standard deviation of each
P = len(SPREAD)
SUBSET = (1, 2)  # the share of vectors a concentration step keeps; what makes up less than the rest cannot move an estimate
LEAST_ROWS = 100
FEW_GROUPS = 100_000
TRIAL_STEPS = 2
MOST_STEPS = 12
TAIL = 1e-5  # of normal vectors that the last distance rejects
BLANKS = " \t\n\x0b\f\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BUCKETS = 64  # to a doubling of the squared distance
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def chi_square(q: float, k: int = P) -> float:
    """Quantile of the chi-square law: bisection on the series of the incomplete gamma function."""

    def below(x: float) -> float:
        a, x = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))

    lo, hi = 1e-9, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < q else (lo, mid)
    return lo


# ---------------------------------------------------------------- measuring texts


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the five measures, n_lines and base_failed; each step is a column of its own, so nothing is computed twice."""
    n = own_names(docs, "text", "bare", "words", "hashes", "windows", "sorted", "twice", "lines")
    c = {k: F.col(v) for k, v in n.items()}
    none = F.array().cast("array<string>")
    d = docs.withColumn(n["text"], F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn(n["bare"], F.btrim(c["text"], F.lit(BLANKS)))
    d = d.withColumns({
        n["words"]: F.when(c["bare"] == "", none).otherwise(F.split(c["bare"], r"[\x20\x09-\x0D]+")),
        n["lines"]: F.filter(F.split(c["text"], "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
    })
    d = d.withColumns({
        "n_words": F.size(c["words"]).cast("long"),
        "word_chars": F.length(F.array_join(c["words"], "")).cast("long"),
        "n_symbols": (F.length(c["text"]) - F.length(F.regexp_replace(c["text"], "[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size(c["lines"]).cast("long"),
        "n_dup_lines": (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        n["hashes"]: F.transform(c["words"], lambda x: F.xxhash64(x)),
    })
    later = lambda k, i: F.get(c["hashes"], i + k)
    d = d.withColumn(n["windows"], F.slice(F.transform(c["hashes"], lambda x, i: F.xxhash64(x, later(1, i), later(2, i))), 1, F.greatest(F.size(c["hashes"]) - 2, F.lit(0))))
    repeats = F.size(F.array_distinct(c["windows"])) < F.size(c["windows"])
    pairs = F.transform(c["windows"], lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    d = d.withColumn(n["sorted"], F.when(repeats, F.sort_array(pairs)))
    same = lambda x, j: x["h"] == F.get(c["sorted"], j)["h"]
    twice = F.transform(F.filter(c["sorted"], lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"])
    d = d.withColumn(n["twice"], twice)
    covered = F.size(F.array_distinct(F.flatten(F.transform(c["twice"], lambda i: F.array(i, i + 1, i + 2)))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(c["twice"].isNotNull(), covered), F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.drop(*n.values())


def transformed() -> list[Column]:
    """The five statistics in whole 128ths: size, word length, and shares of symbols, repeated lines and repeated words."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    x = [F.log(F.col("n_words") + 1.0), F.log(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1))), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.round(SCALE * c).cast("long").alias(n) for c, n in zip(x, X, strict=True)]


# ---------------------------------------------------------------- estimates: a row for each group and start


def near(estimates: DataFrame, groups: int) -> DataFrame:
    """Small enough to broadcast, or left to the join."""
    return F.broadcast(estimates) if groups <= FEW_GROUPS else estimates


def factored(scatter: DataFrame) -> DataFrame:
    """m0.. and c00.. (a covariance) -> the same with its Cholesky factor l00.. and the logarithm of its determinant."""
    for j in range(P):
        rest = lambda i, j=j: F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        scatter = scatter.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest(j), F.lit(1e-6))))
        scatter = scatter.withColumns({f"l{i}{j}": rest(i) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    return scatter.withColumn("size", sum((2 * F.log(f"l{j}{j}") for j in range(P)), F.lit(0.0)))


LINE = [*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in PAIRS), "size"]


def sums() -> list[Column]:
    """What a covariance needs of its vectors; whole numbers."""
    return [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS)]


def estimated(summed: DataFrame) -> DataFrame:
    """Sums of whole numbers -> mean, factor and determinant of the covariance with the least spread added."""
    mean = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)}
    least = lambda i, j: F.lit((SPREAD[i] * SCALE) ** 2 if i == j else 0.0)
    cov = {f"c{i}{j}": F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + least(i, j) for i, j in PAIRS}
    return factored(summed.withColumns(mean).withColumns(cov))


def with_distance(vectors: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, to vectors that stand beside an estimate."""
    for i in range(P):
        rest = F.col(X[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        vectors = vectors.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return vectors.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0)))


def bucket(d2: Column) -> Column:
    return F.floor(BUCKETS * F.log2(F.greatest(d2, F.lit(1e-6)))).cast("int")


def reached(measured: DataFrame, by: list[str], share: tuple[int, int], name: str) -> DataFrame:
    """For each ``by``, the bucket in which the given share of its rows is reached."""
    counts = measured.groupBy(*by, bucket(F.col("d2")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"upto": upto, "all": F.sum("n").over(w)})
    return counts.where(F.col("upto") * share[1] >= F.col("all") * share[0]).groupBy(*by).agg(F.min("b").alias(name))


def starts(vectors: DataFrame, groups: int) -> DataFrame:
    """Three first estimates for each group, around the medians and spread by the quartiles."""
    long = vectors.select("grp", F.posexplode(F.array(*X)).alias("i", "x")).groupBy("grp", "i", "x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp", "i")
    long = long.withColumns({"upto": F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    at = [F.min(F.when(F.col("upto") * 4 >= k * F.col("all"), F.col("x"))).alias(f"at{k}") for k in (1, 2, 3)]
    least = F.get(F.array(*[F.lit(s * SCALE) for s in SPREAD]), F.col("i"))
    spread = long.groupBy("grp", "i").agg(*at).withColumn("sd", F.greatest((F.col("at3") - F.col("at1")) / 1.349, least))
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    middle = spread.groupBy("grp").agg(*[pick(i, "at2").alias(f"m{i}") for i in range(P)], *[pick(i, "sd").alias(f"sd{i}") for i in range(P)])
    middle = written(middle, "middle")
    z = [(F.col(X[i]) - F.col(f"m{i}")) / F.col(f"sd{i}") for i in range(P)]
    d = vectors.join(near(middle, groups), "grp").select("grp", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0)))
    d = d.withColumn("r", F.greatest(length, F.lit(1e-9)))
    whole = lambda c: F.round(1024 * c).cast("long")
    d = d.select("grp", *[whole(F.tanh(f"z{i}")).alias(f"t{i}") for i in range(P)], *[whole(F.col(f"z{i}") / F.col("r")).alias(f"u{i}") for i in range(P)])
    of_scores = [F.count(F.lit(1)).alias("n"), *[F.sum(f"t{i}").alias(f"a{i}") for i in range(P)], *[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"b{i}{j}") for i, j in PAIRS], *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"e{i}{j}") for i, j in PAIRS]]
    d = d.groupBy("grp").agg(*of_scores).join(middle, "grp")
    cov = lambda i, j: F.col(f"b{i}{j}") / F.col("n") - F.col(f"a{i}") / F.col("n") * (F.col(f"a{j}") / F.col("n"))
    d = d.withColumns({f"v{i}": cov(i, i) + 1 for i in range(P)})
    scale = lambda i, j: F.col(f"sd{i}") * F.col(f"sd{j}")
    by = {
        0: lambda i, j: F.lit(1.0 if i == j else 0.0),
        1: lambda i, j: F.lit(1.0) if i == j else cov(i, j) / F.sqrt(F.col(f"v{i}") * F.col(f"v{j}")),
        2: lambda i, j: (F.col(f"e{i}{j}") / F.col("n") * (P / 1024**2) + (0.01 if i == j else 0.0)),
    }
    mean = [F.col(f"m{i}").cast("double").alias(f"m{i}") for i in range(P)]
    out = [factored(d.select("grp", F.lit(k).alias("start"), *mean, *[(scale(i, j) * f(i, j)).alias(f"c{i}{j}") for i, j in PAIRS])) for k, f in by.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("grp", "start", *LINE)


def concentrated(vectors: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """One concentration step of every group and start; ``moved`` tells whether the subset's sums changed the estimate."""
    d = with_distance(vectors.join(near(estimates, groups), "grp"))
    cut = reached(d, ["grp", "start"], SUBSET, "cut")
    inner = d.join(near(cut, groups), ["grp", "start"]).where(bucket(F.col("d2")) <= F.col("cut")).groupBy("grp", "start").agg(*sums())
    old = estimates.select("grp", "start", F.struct(*LINE).alias("old"))
    return estimated(inner).join(old, ["grp", "start"]).select("grp", "start", *LINE, (F.struct(*LINE) != F.col("old")).alias("moved"))


def scaled(vectors: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """Estimates with ``factor``: what squared distances are divided by so that their median is the normal law's; at least 1."""
    half = reached(with_distance(vectors.join(near(estimates, groups), "grp")), ["grp"], (1, 2), "half")
    median = F.pow(F.lit(2.0), (F.col("half") + 1) / BUCKETS)
    return estimates.join(half, "grp").withColumn("factor", F.greatest(median / chi_square(0.5), F.lit(1.0))).drop("half")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The distinct vectors with their group, which group each language and source (l, s) belongs to, and how many such there are."""
    distinct = written(docs.where(~F.col("base_failed")).select("l", "s", "n_lines", *MEASURES).distinct().select("l", "s", *transformed()), "vectors")
    sizes = distinct.groupBy("l", "s").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < LEAST_ROWS, F.col("n")).otherwise(0)
    pooled = F.sum(small).over(Window.partitionBy("l"))
    name = F.when(F.col("n") >= LEAST_ROWS, F.to_json(F.array("l", "s"))).when(pooled >= LEAST_ROWS, F.to_json(F.array("l"))).otherwise("[]")
    sizes = written(sizes.select("l", "s", name.alias("grp")), "groups")
    n = sizes.count()
    same = [F.col("a.l").eqNullSafe(F.col("b.l")), F.col("a.s").eqNullSafe(F.col("b.s"))]
    vectors = written(distinct.alias("a").join(near(sizes, n).alias("b"), same).select("b.grp", *[f"a.{x}" for x in X]), "grouped")
    return vectors, sizes, n


def fit(docs: DataFrame) -> tuple[DataFrame, int]:
    """The final estimate of every (l, s): LINE and factor."""
    vectors, sizes, groups = grouped(docs)
    estimates, folder = written(starts(vectors, groups), "starts"), shared_folder(docs.sparkSession, "steps")
    for step in range(MOST_STEPS):
        if step == TRIAL_STEPS:
            best = F.row_number().over(Window.partitionBy("grp").orderBy("size", "start"))
            estimates = estimates.withColumn("best", best).where("best = 1").drop("best")
        path = f"{folder}/{step}"
        found = concentrated(vectors, estimates.select("grp", "start", *LINE), groups)
        found.write.parquet(path)
        estimates = docs.sparkSession.read.schema(found.schema).parquet(path)
        if step > TRIAL_STEPS and not estimates.where("moved").limit(1).collect():
            break
    raw = written(scaled(vectors, estimates.select("grp", *LINE), groups), "raw")
    inner = with_distance(vectors.join(near(raw, groups), "grp")).where(F.col("d2") / F.col("factor") <= chi_square(0.975))
    last = written(estimated(inner.groupBy("grp").agg(*sums())).select("grp", *LINE), "reweighted")
    return written(sizes.join(scaled(vectors, last, groups), "grp").drop("grp"), "estimates"), groups


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",), tail: float = TAIL) -> DataFrame:
    """``keep`` columns with the measures, base_failed, distance (of what passes the base rules) and kept."""
    names = [f"k{i}" for i in range(len(keep))]
    d = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(lang_col).cast("string").alias("l"), F.col(source_col).cast("string").alias("s"), F.col(text_col).alias("text"))
    d = written(measured(d).drop("text"), "measured")
    estimates, groups = fit(d)
    judged = d.select("*", *transformed()).alias("a").join(near(estimates, groups).alias("b"), [F.col("a.l").eqNullSafe(F.col("b.l")), F.col("a.s").eqNullSafe(F.col("b.s"))], "left")
    judged = with_distance(judged.drop("l", "s"))
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.col("factor"))
    judged = judged.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi_square(1 - tail)))
    return judged.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *MEASURES, "base_failed", "distance", "kept")
