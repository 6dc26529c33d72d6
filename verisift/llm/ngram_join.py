"""N-gram Jaccard join by multiple-global-order prefix filtering.

A document's set holds its distinct 5-word shingles (words: runs of characters that are not white space, A-Z read as a-z;
fewer words: the whole sequence as one shingle). Two documents link at a Jaccard similarity of 0.8 or more.

1. Classes. Documents of equal sets are one class (64-bit order-free hash of the set, checked against a second one).
   Only classes are compared; copies are never expanded into pairs.
2. Frequencies. Shingles are hashed to 64 bits, dealt into buckets by leading bits in packed rows (one row for each batch
   of texts and bucket), and counted there exactly. A shingle that many texts of one batch hold is sent as one count,
   so a line that a third of all texts share does not fill a bucket. What is shared (frequency 2 or more) goes back to
   its batch.
3. Prefixes under several global orders, all rare-first with different ties (by frequency, by its power of two, and by
   its power of four). Of n shingles, n - ceil(0.8 n) + 1 are the prefix; shingles nobody shares come first, so a class
   whose unshared shingles fill the prefix can link with nothing and drops out. Linking classes share a prefix shingle
   under each order.
4. Pivots. Classes with the same prefix shingle (first order) are compared with that list's least class only; links
   give components. A list whose classes are all in one component holds nothing more to find.
5. The rest. Short lists with several components give the pairs across components. Long ones are joined into groups; in a
   group every class outside its largest component meets the whole group, in blocks of bounded size, and only links
   leave a block. In both, a pair must pass the length filter and share a prefix shingle under every order before its
   full sets are intersected.

The result is exact: each pair that could link is compared, or already connected. No bucket, list, partner or candidate
is capped.

Defined results: null, empty or wordless texts have no shingles and link with nothing (their component is their own id);
a null id never names a component unless all ids of it are null; repeated rows get equal results; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordScan, arrow_bytes, checkpointed, mix64, own_names, pieces, signed, slices, text_bytes
from .components import components

SHINGLE = 5
SHARE, OF = 80, 100
#: Shingles in a packed batch, and in a counting bucket, about; texts of one batch that make a shingle a counted one.
BATCH, BUCKET, COMMON = 600_000, 1_000_000, 48
#: Lists up to this length give pairs; blocks of a group hold so many classes.
SHORT, BLOCK_S, BLOCK_M = 64, 256, 1024
#: Bytes of text hashed at once (about 60 times as much memory for a moment).
PIECE = 1 << 18


def floor_share(n: np.ndarray | int):
    """ceil(0.8 n) in integers."""
    return -(-SHARE * n // OF)


# ---------------------------------------------------------------- shingles of a batch of texts


def shingled(buf: np.ndarray, offsets: np.ndarray, scan: WordScan) -> tuple[np.ndarray, np.ndarray]:
    """-> distinct shingle hashes of all texts end to end, and where each text's begin (the end last)."""
    out: list[np.ndarray] = []
    ends = [0]
    total = 0
    lengths = np.diff(offsets)
    for a, b in slices(lengths, PIECE):
        lo, hi = int(offsets[a]), int(offsets[b])
        words, first = scan(buf[lo:hi], offsets[a : b + 1] - lo)
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(len(words) - SHINGLE + 1, 0), U64)
            for j in range(SHINGLE):
                rolled = rolled * U64(0x9E3779B97F4A7C15) + mix64(words[j : j + len(rolled)], 3 + j)
        rolled = mix64(rolled, 11)
        for i in range(b - a):
            s, e = int(first[i]), int(first[i + 1])
            if e - s >= SHINGLE:
                h = np.unique(rolled[s : e - SHINGLE + 1])
            elif e > s:
                h = np.zeros(1, U64)
                with np.errstate(over="ignore"):
                    for w in words[s:e]:
                        h = mix64(h * U64(31) + w, 20 + e - s)
            else:
                h = np.zeros(0, U64)
            out.append(h)
            total += len(h)
            ends.append(total)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.array(ends, np.int64)


def set_hash(h: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each set that does not depend on the order of its members."""
    n = np.diff(ends)
    with np.errstate(over="ignore"):
        total = np.concatenate(([U64(0)], np.cumsum(mix64(h, salt), dtype=U64)))
        return mix64(total[ends[1:]] - total[ends[:-1]] + n.astype(U64) * U64(0x9E3779B97F4A7C15), salt + 1)


def with_class(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces the text by n_shingles, cls (hash of the set) and cls2 (a second one)."""
    names = own_names(df, "t")
    keep = [c for c in df.columns if c != text_col]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias(names["t"]))
    schema = src.drop(names["t"]).withColumns({"n_shingles": F.lit(0).cast("long"), "cls": F.lit(0).cast("long"), "cls2": F.lit(0).cast("long")}).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = WordScan(PIECE)
        for batch in batches:
            h, ends = shingled(*arrow_bytes(batch.column(batch.schema.get_field_index(names["t"]))), scan)
            new = [pa.array(np.diff(ends)), pa.array(signed(set_hash(h, ends, 30))), pa.array(signed(set_hash(h, ends, 40)))]
            old = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != names["t"]]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[*keep, "n_shingles", "cls", "cls2"])

    return src.mapInArrow(work, schema)


# ---------------------------------------------------------------- exact frequencies of shared shingles

PACKED = "route int, kind int, batch long, part int, cls binary, counts binary, tokens binary"


def packed_tokens(df: DataFrame, bits: int, text_col: str) -> DataFrame:
    """Rows for the counting buckets.

    kind 0, routed to a bucket: the batch's classes, tokens of each in this bucket, and the tokens' other bits.
    kind 1, routed to a bucket: tokens that many classes of the batch hold, with their number.
    kind 2, routed by batch, for the batch itself: the same tokens with the classes that hold them.
    kind 3, routed by batch: the batch's classes with the sizes of their sets.
    """
    short = (64 - bits + 7) // 8

    def pack(x: np.ndarray) -> bytes:
        return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :short]).tobytes()

    def emit(sets: list[np.ndarray], cls: list[int], batch: int) -> Iterator[dict]:
        n = np.array([len(s) for s in sets], np.int64)
        of, tok = np.repeat(np.arange(len(sets), dtype=np.int32), n), np.concatenate(sets)
        names = np.array(cls, np.int64)
        yield {"route": batch & 0x7FFFFFFF, "kind": 3, "batch": batch, "part": 0, "cls": names.tobytes(), "counts": n.tobytes(), "tokens": b""}
        order = np.argsort(tok, kind="stable")
        tok, of = tok[order], of[order]
        edge = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        runs = np.diff(np.r_[edge, len(tok)])
        many = np.repeat(runs >= COMMON, runs)
        common, size = tok[edge[runs >= COMMON]], runs[runs >= COMMON]
        if len(common):
            yield {"route": batch & 0x7FFFFFFF, "kind": 2, "batch": batch, "part": 0, "cls": of[many].tobytes(), "counts": size.astype(np.int64).tobytes(), "tokens": common.tobytes()}
            where = (common >> U64(64 - bits)).astype(np.int64)
            for p in np.unique(where):
                at = where == p
                yield {"route": int(p), "kind": 1, "batch": batch, "part": int(p), "cls": b"", "counts": size[at].astype(np.int64).tobytes(), "tokens": pack(common[at])}
        tok, of = tok[~many], of[~many]
        cut = np.searchsorted(tok >> U64(64 - bits), np.arange((1 << bits) + 1).astype(U64))
        for p in range(1 << bits):
            a, b = cut[p], cut[p + 1]
            if a < b:
                o = np.argsort(of[a:b], kind="stable")
                who, t = of[a:b][o], tok[a:b][o]
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                yield {"route": p, "kind": 0, "batch": batch, "part": p, "cls": names[who[first]].tobytes(), "counts": np.diff(np.r_[first, len(who)]).astype("<u4").tobytes(), "tokens": pack(t)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scan, number = WordScan(PIECE), TaskContext.get().partitionId() << 24
        schema = pa.schema([("route", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("part", pa.int32()), ("cls", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
        sets: list[np.ndarray] = []
        cls: list[int] = []
        held, size = set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sets, cls, held, size, number
            if sets:
                rows = list(emit(sets, cls, number))
                for a in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 64], schema=schema)
                number += 1
            sets, cls, held, size = [], [], set(), 0

        for batch in batches:
            h, ends = shingled(*arrow_bytes(batch.column(0)), scan)
            c = signed(set_hash(h, ends, 30))
            for i in range(len(c)):
                a, b = int(ends[i]), int(ends[i + 1])
                if b > a and c[i] not in held:
                    held.add(c[i])
                    cls.append(int(c[i]))
                    sets.append(h[a:b])
                    size += b - a
                    if size >= BATCH:
                        yield from flush()
        yield from flush()

    return df.select(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))).mapInArrow(work, PACKED)


def shared_tokens(packed: DataFrame, bits: int) -> DataFrame:
    """Counts each bucket; sends shared tokens (frequency 2 or more) back to their batches, packed."""
    short = (64 - bits + 7) // 8
    cols = PACKED.replace("route int, ", "").replace("part int, ", "")

    def unpack(data: bytes, part: int) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8).reshape(-1, short)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :short] = raw
        low = wide.view("<u8").ravel()
        if bits:
            low = (low & U64((1 << (64 - bits)) - 1)) | U64(part << (64 - bits))
        return low

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = [frame.loc[frame["kind"] >= 2, ["kind", "batch", "cls", "counts", "tokens"]]]
        for part, rows in frame[frame["kind"] < 2].groupby("part"):
            light, heavy = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
            tok = [unpack(t, int(part)) for t in light["tokens"]]
            own = [np.repeat(np.frombuffer(c, np.int64), np.frombuffer(k, "<u4")) for c, k in zip(light["cls"], light["counts"])]
            batch = np.repeat(light["batch"].to_numpy(np.int64), [len(t) for t in tok])
            t = np.concatenate(tok) if tok else np.zeros(0, U64)
            c = np.concatenate(own) if own else np.zeros(0, np.int64)
            ht = [unpack(x, int(part)) for x in heavy["tokens"]]
            hn = [np.frombuffer(x, np.int64) for x in heavy["counts"]]
            hb = np.repeat(heavy["batch"].to_numpy(np.int64), [len(x) for x in ht])
            ht = np.concatenate(ht) if len(ht) else np.zeros(0, U64)
            hn = np.concatenate(hn) if len(hn) else np.zeros(0, np.int64)
            # classes seen in several batches count once, except for tokens already counted in bulk
            pair = mix64(t, 50) ^ mix64(c.view(U64), 51)
            _, one = np.unique(pair, return_index=True)
            names, inv = np.unique(np.concatenate([t[one], ht]), return_inverse=True)
            df = np.bincount(inv, weights=np.concatenate([np.ones(len(one)), hn]), minlength=len(names)).astype(np.int64)
            f = df[np.searchsorted(names, t)] if len(t) else np.zeros(0, np.int64)
            keep = f >= 2
            t, c, f, batch = t[keep], c[keep], f[keep], batch[keep]
            got = []
            for b in np.unique(batch):
                at = batch == b
                got.append((0, int(b), c[at].tobytes(), f[at].tobytes(), t[at].tobytes()))
            hf = df[np.searchsorted(names, ht)] if len(ht) else hn
            for b in np.unique(hb):
                at = hb == b
                got.append((1, int(b), b"", hf[at].tobytes(), ht[at].tobytes()))
            out.append(pd.DataFrame(got, columns=["kind", "batch", "cls", "counts", "tokens"]))
        return pd.concat(out, ignore_index=True)

    return packed.groupBy("route").applyInPandas(count, cols)


# ---------------------------------------------------------------- prefixes


def orders(tokens: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    """Positions of a set's shared tokens under each global order: rare first, ties by different hashes."""
    two = np.floor(np.log2(freq)).astype(np.int64)
    keys = [(mix64(tokens, 60), freq), (mix64(tokens, 61), two), (mix64(tokens, 62), two // 2)]
    return [np.lexsort(k) for k in keys]


def survivors(back: DataFrame) -> DataFrame:
    """(cls, n, tokens, freqs): classes whose prefix reaches their shared tokens; all their shared tokens, in the first order."""

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["kind"] == 3]
        if not len(own):
            raise ValueError("shared tokens without their batch: the input's partitions changed between runs")
        names, n = np.frombuffer(own["cls"].iloc[0], np.int64), np.frombuffer(own["counts"].iloc[0], np.int64)
        c, t, f = [], [], []
        light = frame[frame["kind"] == 0]
        for x, y, z in zip(light["cls"], light["counts"], light["tokens"]):
            c.append(np.frombuffer(x, np.int64))
            f.append(np.frombuffer(y, np.int64))
            t.append(np.frombuffer(z, U64))
        df = {}
        for y, z in zip(frame.loc[frame["kind"] == 1, "counts"], frame.loc[frame["kind"] == 1, "tokens"]):
            df.update(zip(np.frombuffer(z, U64).tolist(), np.frombuffer(y, np.int64).tolist()))
        for x, y, z in zip(*(frame.loc[frame["kind"] == 2, k] for k in ("cls", "counts", "tokens"))):
            who, size, tok = np.frombuffer(x, np.int32), np.frombuffer(y, np.int64), np.frombuffer(z, U64)
            c.append(names[who])
            t.append(np.repeat(tok, size))
            f.append(np.repeat(np.array([df[k] for k in tok.tolist()], np.int64), size))
        out = []
        if c:
            c, t, f = np.concatenate(c), np.concatenate(t), np.concatenate(f)
            order = np.argsort(c, kind="stable")
            c, t, f = c[order], t[order], f[order]
            edge = np.r_[np.flatnonzero(np.r_[True, c[1:] != c[:-1]]), len(c)]
            size = dict(zip(names.tolist(), n.tolist()))
            for a, b in zip(edge[:-1], edge[1:]):
                k = size[int(c[a])]
                if b - a >= floor_share(k):  # the prefix reaches past the unshared ones: u < n - ceil(0.8 n) + 1
                    tt, ff = t[a:b], f[a:b]
                    o = orders(tt, ff)[0]
                    out.append((int(c[a]), k, tt[o].tobytes(), ff[o].tobytes()))
        return pd.DataFrame(out, columns=["cls", "n", "tokens", "freqs"])

    found = back.groupBy("batch").applyInPandas(work, "cls long, n long, tokens binary, freqs binary")
    return found.groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("freqs").alias("freqs"))


def prefix_length(n: int, shared: int) -> int:
    """How many of the shared tokens are in the prefix."""
    return n - floor_share(n) + 1 - (n - shared)


class Sets:
    """A block of classes in memory."""

    def __init__(self, cls, n, tokens, freqs):
        self.cls, self.n = np.asarray(cls, np.int64), np.asarray(n, np.int64)
        self.tokens = [np.frombuffer(t, U64) for t in tokens]
        self.prefix: list[list[np.ndarray]] = []
        for k, t, f in zip(self.n, self.tokens, (np.frombuffer(f, np.int64) for f in freqs)):
            p = prefix_length(int(k), len(t))
            self.prefix.append([np.sort(t[o[:p]]) for o in orders(t, f)])


def similar(na: int, nb: int, a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARE * (na + nb - both)


def may_link(x: Sets, i: int, y: Sets, j: int) -> bool:
    """Length filter, then a common prefix token under every order."""
    small, large = sorted((int(x.n[i]), int(y.n[j])))
    if OF * small < SHARE * large:
        return False
    return all(len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x.prefix[i], y.prefix[j]))


def prefix_entries(found: DataFrame) -> DataFrame:
    """(token, cls): the prefixes under the first order."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fr in frames:
            toks = [np.frombuffer(t, np.int64) for t in fr["tokens"]]
            p = [prefix_length(int(n), len(t)) for n, t in zip(fr["n"], toks)]
            if p:
                yield pd.DataFrame({"token": np.concatenate([t[:k] for t, k in zip(toks, p)]), "cls": np.repeat(fr["cls"].to_numpy(np.int64), p)})

    return found.select("cls", "n", "tokens").mapInPandas(work, "token long, cls long")


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    side = lambda s: found.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "tokens", "freqs")])
    both = pairs.join(side("a"), F.col("a") == F.col("cls_a")).join(side("b"), F.col("b") == F.col("cls_b"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fr in frames:
            x, y = (Sets(*(fr[f"{c}_{s}"] for c in ("cls", "n", "tokens", "freqs"))) for s in "ab")
            ok = [may_link(x, i, y, i) and similar(int(x.n[i]), int(y.n[i]), x.tokens[i], y.tokens[i]) for i in range(len(fr))]
            yield pd.DataFrame({"a": x.cls[ok], "b": y.cls[ok]})

    return both.drop("a", "b").mapInPandas(work, "a long, b long")


def labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    return entries.join(labels.select(F.col("v").alias("_v"), F.col("root").alias("_r")), F.col("cls") == F.col("_v"), "left").select("token", "cls", F.coalesce("_r", "cls").alias("label"))


def block_links(groups: DataFrame, found: DataFrame) -> DataFrame:
    """groups: (grp, cls, label). Every class outside a group's largest component meets the whole group, in blocks."""
    size = groups.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("k"))
    large = size.groupBy("grp").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    large = large.select(F.col("grp").alias("_g"), F.col("top.label").alias("_top"), F.ceil(F.col("m") / BLOCK_M).alias("mb"), F.ceil((F.col("m") - F.col("top.k")) / BLOCK_S).alias("sb"))
    members = groups.join(large, F.col("grp") == F.col("_g")).join(found, "cls")
    i = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n)).cast("int")
    cols = ["grp", "cls", "label", "n", "tokens", "freqs"]
    rest = members.where(F.col("label") != F.col("_top")).select(*cols, F.lit(True).alias("probe"), i("sb", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb").cast("int") - 1)).alias("j"))
    whole = members.select(*cols, F.lit(False).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("sb").cast("int") - 1)).alias("i"), i("mb", 2).alias("j"))

    def work(key: tuple, fr: pd.DataFrame) -> pd.DataFrame:
        s, m = fr[fr["probe"]], fr[~fr["probe"]]
        x, y = (Sets(f["cls"], f["n"], f["tokens"], f["freqs"]) for f in (s, m))
        sl, ml = s["label"].to_numpy(np.int64), m["label"].to_numpy(np.int64)
        vocab = np.unique(np.concatenate([*x.tokens, np.zeros(0, U64)]))
        flat = lambda sets: (np.concatenate([*sets, np.zeros(0, U64)]), np.repeat(np.arange(len(sets)), [len(q) for q in sets]))
        known, placed = [], []
        for k in range(4):  # three prefixes, then the full sets
            t, of = flat(y.tokens if k == 3 else [p[k] for p in y.prefix])
            at = np.searchsorted(vocab, t)
            hit = (at < len(vocab)) & (vocab[np.minimum(at, max(len(vocab) - 1, 0))] == t) if len(vocab) else np.zeros(len(t), bool)
            known.append(at[hit])
            placed.append(of[hit])
        out = []
        mark = np.zeros(len(vocab) + 1, bool)

        def common(k: int, tokens: np.ndarray) -> np.ndarray:
            at = np.searchsorted(vocab, tokens)
            mark[at] = True
            got = np.bincount(placed[k], weights=mark[known[k]], minlength=len(y.cls)).astype(np.int64)
            mark[at] = False
            return got

        for p in range(len(x.cls)):
            n = int(x.n[p])
            cand = (ml != sl[p]) & (OF * np.minimum(y.n, n) >= SHARE * np.maximum(y.n, n))
            for k in range(3):
                if cand.any():
                    cand &= common(k, x.prefix[p][k]) > 0
            if cand.any():
                both = common(3, x.tokens[p])
                cand &= OF * both >= SHARE * (y.n + n - both)
                hits = np.flatnonzero(cand)
                _, one = np.unique(ml[hits], return_index=True)  # one link to each component is enough
                out += [(int(x.cls[p]), int(y.cls[q])) for q in hits[one]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rest.unionByName(whole).groupBy("grp", "i", "j").applyInPandas(work, "a long, b long")


def links(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(v, root): components over classes with at least one link to another class."""
    _, size = text_bytes(df, text_col)
    bits = max(8, math.ceil(math.log2(max(1, size / 6 / BUCKET))))
    back = shared_tokens(packed_tokens(df, bits, text_col), bits)
    found = checkpointed(survivors(back))
    entries = checkpointed(prefix_entries(found))

    lists = entries.groupBy("token").agg(F.min("cls").alias("pivot"), F.count(F.lit(1)).alias("k")).where("k > 1")
    lists = checkpointed(lists)
    pairs = entries.join(lists, "token").where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct()
    first = checkpointed(verified(pairs, found))
    labels = checkpointed(components(first))

    marked = checkpointed(labelled(entries.join(lists.select("token", "k", "pivot"), "token").select("token", "cls"), labels).join(lists, "token"))
    mixed = marked.groupBy("token").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("token")
    open_lists = marked.join(mixed, "token")

    short = open_lists.where(F.col("k") <= SHORT)
    left, right = (short.select("token", F.col("cls").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    rest = left.join(right, "token").where("a < b and la <> lb").select("a", "b").distinct()
    more = verified(rest, found)

    long = open_lists.where(F.col("k") > SHORT)
    if long.take(1):
        groups = components(long.select(F.col("pivot").alias("a"), F.col("cls").alias("b")))
        members = groups.select(F.col("root").alias("grp"), F.col("v").alias("cls")).join(labels.select(F.col("v").alias("_v"), F.col("root").alias("_r")), F.col("cls") == F.col("_v"), "left")
        more = more.unionByName(block_links(checkpointed(members.select("grp", "cls", F.coalesce("_r", "cls").alias("label"))), found))
    return components(checkpointed(first.unionByName(more)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replaces the text by n_shingles and component_id (the least id reachable by links, itself included)."""
    keep = [c for c in df.columns if c not in ("n_shingles", "component_id", "cls", "cls2")]
    rows = with_class(df.select(*[F.col(f"`{c}`") for c in keep]), text_col)
    ident = F.col(f"`{id_col}`")
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(
        F.min(ident).alias("least"),
        F.assert_true((F.min("cls2") == F.max("cls2")) & (F.min("n_shingles") == F.max("n_shingles")), F.lit("two sets with one hash")).alias("_ok"),
    ).where("_ok is null").drop("_ok")
    classes = checkpointed(classes)
    root = links(df, text_col).select(F.col("v").alias("_v"), F.col("root").alias("_r"))
    tagged = classes.join(root, F.col("cls") == F.col("_v"), "left").select("cls", "least", F.coalesce("_r", "cls").alias("_r"))
    least = tagged.groupBy("_r").agg(F.min("least").alias("component_id"))
    answer = checkpointed(tagged.join(least, "_r").select(F.col("cls").alias("_c"), "component_id"))
    out = rows.join(answer, (F.col("cls") == F.col("_c")) & (F.col("n_shingles") > 0), "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(ident)).drop("cls", "cls2", "_c")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies stays: the one with the least id (rows without an id come last), of several
    texts under that id the one with the least hash. Rows without words link with nothing and all stay."""
    names = own_names(df, "key")
    ident, text, key = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), names["key"]
    wordless = ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    place = F.struct(ident.isNull().alias("none"), ident.alias("id"), F.xxhash64(text).alias("hash"))
    marks = near_duplicates(df.where(~wordless).select(place.alias("o"), text.alias("t")), "o", "t")
    name = lambda o: F.concat_ws("\x01", o["none"].cast("string"), F.coalesce(o["id"].cast("string"), F.lit("")), o["hash"].cast("string"))
    stay = marks.where(F.col("o").eqNullSafe(F.col("component_id"))).select(name(F.col("o")).alias(key)).distinct()
    kept = df.where(~wordless).withColumn(key, name(place)).join(stay, key).dropDuplicates([key]).drop(key)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns]).unionByName(df.where(wordless))
