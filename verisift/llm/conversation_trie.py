"""Conversation prefix trie: every distinct sequence of first turns is a node, with totals over its subtree.

A depth-band rollup. Depths are cut into bands of a fixed height. First each node gives its value to its ancestors within
its own band alone (at most one band's height of rows). Then, from the deepest band up, the completed totals of a band's
topmost nodes go to their ancestors in the band above. So a trie of depth D takes about D / height rounds over the
topmost nodes only, and no node explodes to more than ``height`` rows; the height is the root of the deepest depth.

A node is named by its depth and 128 bits: the exclusive-or of two hashes of (place, MD5 of role and text) over its turns.
Places and running hashes are built in two levels, so a conversation that holds a third of all turns is spread over tasks.
Texts are read once and never exchanged twice: behind the first sort a turn is an MD5, a length and two numbers.

Defined cases: rows without a conversation id take no part. A null role or text counts as empty. Turns come by number,
null first; equal numbers by role, then text (code points); repeated rows are turns of their own. An empty table has no
node, not even a root. Other columns are not read. Texts of any length count as a whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, written

LEAST_HEIGHT = 8  # of a band
CHUNK_BITS = 10  # a running hash is built over 1,024 turns at a time
ENDS_BITS = 9  # ids of 512 neighbouring numbers are joined into one string
HOT_SHARE = 1000  # a node with a thousandth of all nodes as children; there can be no more than 1,000 such nodes
KEY = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, at, md5, bytes): all turns in a global sort; ``at`` rises with it and is gapless within a part."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "row"]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    d = d.select("conv", at.alias("at"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("md5"), F.octet_length("text").cast("long").alias("bytes"))
    return written(d, "turns").withColumn("part", F.shiftright("at", 33))


def rebuilt(turns: DataFrame, lender: Column | None = None, lent: Column | None = None, most_lent: int = 8) -> DataFrame:
    """(conv, depth, size, md5, bytes): each conversation's turns by place.

    With ``lender`` and ``lent`` (columns of ``conv``; at most ``most_lent``), a conversation begins with the lender's first
    ``lent`` turns in place of as many of its own.
    """
    firsts = turns.groupBy("conv", "part").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    size = firsts.groupBy("conv").agg(F.sum("n").alias("own"))
    convs = size.select("conv", "own", (F.lit(0) if lent is None else lent).cast("long").alias("h"), (F.col("conv") if lender is None else lender).alias("lender"))
    convs = convs.join(size.select(F.col("conv").alias("lender"), F.col("own").alias("theirs")), "lender", "left")
    convs = convs.withColumn("shared", F.least("h", F.coalesce("theirs", F.lit(0)))).withColumn("size", F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv", "lender", "h", "shared", "size"), "convs")
    placed = turns.join(firsts.join(convs, "conv"), ["conv", "part"]).withColumn("place", F.col("at") - F.col("lo") + 1 + F.col("before"))
    rows = placed.where("place > h").select("conv", (F.col("shared") + F.col("place") - F.col("h")).alias("depth"), "size", "md5", "bytes")
    if lent is not None:
        given = placed.where(F.col("place") <= most_lent).select(F.col("conv").alias("lender"), "place", "md5", "bytes")
        rows = rows.unionByName(given.join(convs, "lender").where("place <= h").select("conv", F.col("place").alias("depth"), "size", "md5", "bytes"))
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), "size", F.lit(None).cast("string").alias("md5"), F.lit(0).cast("long").alias("bytes"))
    return rows.unionByName(root)


def _members(rows: DataFrame, height: int) -> DataFrame:
    """A row for each conversation and depth: the node's key, its parent's, the band, and whether the conversation ends there."""
    l1, l2 = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64("depth", "md5")), F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64("md5", "depth", F.lit("second")))
    rows = rows.select("conv", "depth", "bytes", (F.col("depth") == F.col("size")).alias("ends"), l1.cast("long").alias("l1"), l2.cast("long").alias("l2"), F.shiftright("depth", CHUNK_BITS).alias("chunk"))
    up_to = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = rows.groupBy("conv", "chunk").agg(F.bit_xor("l1").alias("c1"), F.bit_xor("l2").alias("c2"))
    later = later.select("conv", "chunk", F.expr("bit_xor(c1)").over(before).alias("c1"), F.expr("bit_xor(c2)").over(before).alias("c2")).where("chunk > 0")
    rows = rows.withColumns({"x1": F.bit_xor("l1").over(up_to), "x2": F.bit_xor("l2").over(up_to)}).join(later, ["conv", "chunk"], "left")
    for k in "12":
        rows = rows.withColumn(f"k{k}", F.col(f"x{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0)))).withColumn(f"p{k}", F.col(f"k{k}").bitwiseXOR(F.col(f"l{k}")))
    return rows.select("conv", *KEY, "p1", "p2", "bytes", "ends", F.floor(F.col("depth") / height).cast("int").alias("band"))


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids in ascending order, joined by commas; the ids pass as short strings, hashed as they come."""
    chunks = ends.groupBy(*KEY, F.shiftright("conv", ENDS_BITS).alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    chunks = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "g")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for frame in frames:
            out = []
            for depth, k1, k2, ids in zip(*(frame[c] for c in (*KEY, "ids"))):
                if (depth, k1, k2) != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (depth, k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    return chunks.mapInPandas(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _subtrees(nodes: DataFrame, members: DataFrame, height: int) -> DataFrame:
    """Sums of leaf and saved over each node's subtree: within bands first, then round by round from the deepest band up."""
    spark, folder = nodes.sparkSession, shared_folder(nodes.sparkSession, "rollup")
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    way = members.select("band", "conv", F.col("depth").alias("up"), F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    key = [F.col("up").alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")]
    # a node's least conversation passes through every ancestor, so an equality join finds those in its band
    own = nodes.select("conv", "band", "depth", "leaves", "saved").join(way, ["conv", "band"]).where("up <= depth").drop("depth")
    own = own.groupBy(*key, "band").agg(F.min("conv").alias("conv"), *sums)
    own.write.partitionBy("band").parquet(f"{folder}/within")  # a round reads its own band
    own = spark.read.schema(own.schema).parquet(f"{folder}/within")
    last = own.agg(F.max("band")).first()[0]
    if not last:
        return own
    tops, from_below, kept = own.where(F.col("depth") == F.col("band") * height), None, []
    for band in range(last, 0, -1):
        done = tops.where(F.col("band") == band).select("conv", *KEY, "leaves", "saved")
        if from_below is not None:
            more = from_below.select(*KEY, F.col("leaves").alias("l"), F.col("saved").alias("s"))
            done = done.join(more, KEY, "left").select("conv", F.expr("leaves + coalesce(l, 0)").alias("leaves"), F.expr("saved + coalesce(s, 0)").alias("saved"))
        path = f"{folder}/{band - 1}"
        done.select("conv", "leaves", "saved").join(way.where(F.col("band") == band - 1), "conv").groupBy(*key).agg(*sums).write.parquet(path)
        kept.append(path)
        from_below = spark.read.schema("depth long, k1 long, k2 long, leaves long, saved long").parquet(path)
    more = spark.read.schema(from_below.schema).parquet(*kept).select(*KEY, F.col("leaves").alias("l"), F.col("saved").alias("s"))
    return own.join(more, KEY, "left").select(*KEY, F.expr("leaves + coalesce(l, 0)").alias("leaves"), F.expr("saved + coalesce(s, 0)").alias("saved"))


def trie(rows: DataFrame) -> DataFrame:
    """A row for each node of the conversations that :func:`rebuilt` gives: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = written(rows, "places")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    height = max(LEAST_HEIGHT, math.ceil(math.sqrt(deepest)))
    folder = shared_folder(rows.sparkSession, "members")
    members = _members(rows, height)
    members.write.partitionBy("band").parquet(folder)
    members = rows.sparkSession.read.schema(members.schema).parquet(folder)
    grouped = members.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("band").alias("band"))
    grouped = written(grouped, "nodes")
    above = (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")
    children = grouped.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = grouped.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes = written(nodes, "families")
    totals = _subtrees(nodes, members, height).select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    # parents: the few with very many children are broadcast, the others joined by key
    hot = F.col("n_children") * HOT_SHARE >= max(1, nodes.count())
    up = nodes.where("depth > 0").select(*KEY, "p1", "p2")
    parent = [F.col("depth") - 1 == F.col("d"), F.col("p1") == F.col("q1"), F.col("p2") == F.col("q2")]
    name = lambda d: d.select(F.col("depth").alias("d"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv").alias("parent_conv_id"))
    few, rest = F.broadcast(name(nodes.where(hot))), name(nodes.where(~hot))
    parents = up.join(few, parent).unionByName(up.join(few, parent, "left_anti").join(rest, parent)).select(*KEY, "parent_conv_id")
    out = nodes.join(totals, KEY).join(parents, KEY, "left").join(_digests(members.where("ends").select("conv", *KEY)), KEY, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, lender: Column | None = None, lent: Column | None = None, most_lent: int = 8, **columns: str) -> DataFrame:
    """The trie of a table of turns; ``columns`` names conv_col, turn_col, role_col and text_col, :func:`rebuilt` tells the rest."""
    return trie(rebuilt(ordered_turns(conversations, **columns), lender, lent, most_lent))
