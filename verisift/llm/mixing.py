"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Each source wants a share of the total by weight; no source may be repeated more than ``max_epochs`` times. Sources
above that cap are clamped and the words they leave are shared again among the others by weight, until none is above
(each round is one aggregate over the table of sources; three sums pass the driver). A source whose target is r times its size is
taken floor(r) times whole; the rest, a fraction of one more pass, goes to its documents in a seeded order until the
fraction is used up, so the words taken differ from the target by half a document at most.

The seeded order needs no sort of a source: documents fall into buckets by their key's leading digits, and bucket sums give
the one bucket of each source in which the fraction runs out. Documents before it are taken once more, those behind it
are not, and only the documents of that bucket (about ``BUCKET_ROWS`` a source) are exchanged and ranked. So a source with a
third of all rows is spread over all buckets, and all other documents stay where they are: they meet the table of
sources, one row each, by broadcast if it has at most ``FEW_SOURCES`` rows, else in a join whose hot sources are salted.

Defined results: the null source is a source, sorted last; null or wordless texts have size 0 and are taken 0 words; a
source of size 0 has target 0; rows with equal keys and texts are interchangeable; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, own_names, pieces

#: Documents of one source in a bucket, about; rows of a table of sources that is broadcast; sources ranked by one task, about.
BUCKET_ROWS, FEW_SOURCES, RANKED_ROWS = 500, 100_000, 1_000_000
SALTS = 32


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF, CR (null: 0)."""
    t = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(t, " "), "")), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, source_col: str, cycle: int = 3) -> DataFrame:
    """Weights 1 .. cycle, repeating, over the distinct sources by code point, null last.

    Ranked in range partitions: a source's place is its place in its partition behind all sources of the partitions before.
    """
    d = checkpointed(sources.select(source_col).distinct())
    order = F.col(source_col).asc_nulls_last()
    ranged = checkpointed(d.repartitionByRange(pieces(d.count(), RANKED_ROWS), order).withColumn("_p", F.spark_partition_id()))
    counts = {r._p: r.n for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    before, at = {}, 0
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    ahead = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_p")] if before else F.lit(0)
    place = ahead + F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return ranged.select(source_col, (F.pmod(place, F.lit(cycle)) + 1).cast("double").alias("weight"))


def targets(sizes: DataFrame, source_col: str, max_epochs: float = 3, total: float | None = None) -> DataFrame:
    """sizes: (source, source_size, weight). Adds ``target``: capped water-filling of ``total`` (all sizes by default)."""
    t = sizes.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    row = t.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    want = float(row["all"] or 0) if total is None else float(total)
    level, last = (want / row.w if row.w else 0.0), -1
    while True:  # each round clamps at least one more source
        above = F.col("cap") < F.lit(level) * F.col("weight")
        r = t.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("cap"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("w"), F.count_if(above).alias("n")).first()
        if r.n == last or r.w == 0:
            break
        last, level = r.n, (want - r.cap) / r.w
    return t.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("cap")


def mix(df: DataFrame, weights: DataFrame | None = None, source_col: str = "source", size: Column | None = None, max_epochs: float = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add size, source_size, target and ``copies``: how many times the mix takes each row.

    weights: (source, weight), one row a source; by default 1, 2, 3 repeating over the sources. Columns of the input with
    these names are replaced; ``size`` may read them.
    """
    names = own_names(df, "source", "size", "key", "bucket", "salt")
    src, words, key, bucket, salt = (names[k] for k in ("source", "size", "key", "bucket", "salt"))
    tagged = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("null"))  # noqa: E731  a source as a key that is never null
    seeded = F.md5(F.concat_ws("\x01", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    given = df if size is None else df.withColumn(words, size)
    keyed = given.drop("size", "source_size", "target", "copies").withColumns({src: tagged(F.col(source_col)), key: seeded})
    counted = word_count(text_col) if size is None else F.col(words)

    # buckets of the seeded order: as many for every source, so that the largest source has BUCKET_ROWS in each
    rows = checkpointed(df.groupBy(tagged(F.col(source_col)).alias(src)).agg(F.count(F.lit(1)).alias("rows")))
    r = rows.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("most"), F.coalesce(F.sum("rows"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("n")).first()
    n, few = pieces(r.most, BUCKET_ROWS), r.n <= FEW_SOURCES
    keyed = keyed.withColumn(bucket, F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n / F.lit(2**32)))
    sums = checkpointed(keyed.groupBy(src, F.col(source_col).alias("_s"), bucket).agg(F.sum(counted).alias("_b")))

    per_source = checkpointed(sums.groupBy(src, "_s").agg(F.sum("_b").alias("source_size")))
    w = cyclic_weights(per_source.select("_s"), "_s") if weights is None else weights.select(F.col(source_col).alias("_s"), F.col("weight").cast("double"))
    plan = targets(per_source.join(w.select(tagged(F.col("_s")).alias(src), "weight"), src).drop("_s"), src, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("_whole", F.floor(rate).cast("long")).withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size")).drop("weight")

    # the last bucket that begins before the end of the fraction (-1: none), and where it begins: running sums over (source, bucket) sums
    running = Window.partitionBy(src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.drop("_s").withColumn("_before", F.coalesce(F.sum("_b").over(running), F.lit(0))).join(plan, src).where((F.col("_part") > 0) & (F.col("_before") <= F.col("_part")))
    last = begun.groupBy(src).agg(F.max(F.struct(F.col(bucket).alias("b"), F.col("_before").alias("at"))).alias("_e"))
    plan = plan.join(last, src, "left").select(src, "source_size", "target", "_whole", "_part", F.coalesce(F.col("_e.b"), F.lit(-1)).alias("_end"), F.coalesce(F.col("_e.at"), F.lit(0)).alias("_at"))
    plan = checkpointed(plan)

    if few:
        joined = keyed.join(F.broadcast(plan), src)
    else:  # hot sources (at most 256) over SALTS keys
        hot = [x[src] for x in rows.where(F.col("rows") > max(r["all"] / 256, 10_000)).collect()]
        is_hot = F.col(src).isin(hot) if hot else F.lit(False)
        spread = plan.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        joined = keyed.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).otherwise(0)).join(spread, [src, salt]).drop(salt)

    # inside the last bucket a document goes in if its middle is before the end of the fraction
    edge = F.col(bucket) == F.col("_end")
    clear = joined.where(~edge).withColumn(words, counted).withColumn("copies", F.col("_whole") + (F.col(bucket) < F.col("_end")).cast("long"))
    within = F.sum(words).over(Window.partitionBy(src).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    middle = F.col("_at") + F.coalesce(within, F.lit(0)) + F.col(words) / 2
    ranked = joined.where(edge).withColumn(words, counted).withColumn("copies", F.col("_whole") + (middle <= F.col("_part")).cast("long"))
    out = clear.unionByName(ranked)
    return out.withColumnRenamed(words, "size").drop(src, key, bucket, "_whole", "_part", "_end", "_at")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as rows: each document as often as it is taken."""
    names = own_names(mixed, "i")
    return mixed.where("copies > 0").withColumn(names["i"], F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])
