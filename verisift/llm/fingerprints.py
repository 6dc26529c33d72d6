"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A text is a set of paragraph digests: its lines, cut on at sentence and clause ends, trimmed; a piece without such
marks is cut every so often behind a word chosen by its own letters, so equal stretches are cut alike. Each digest goes
to ``HASHES`` cells, one in each part of the table; a cell holds a count, the XOR of its digests and the XOR of their
checks. The sketch of one version minus that of another leaves the differing digests, and peeling (take a cell of
count +-1 whose check fits, remove its digest everywhere, repeat) recovers them with their side. If cells are left over,
both versions are sketched again in a larger table (four times, until it peels). The fingerprint is the smallest table,
of fixed size. Likeness is shared digests over all digests of the two versions; two empty versions are alike (1.0).

Many pairs are peeled at once: their tables lie end to end in one numpy array, so Python works for each round, not for each document.

Defined results: null text is the empty text; equal texts have equal fingerprints; rows of one id follow each other by the
hash of their text, rows without an id come last; extra columns pass through, but for those named like a result, which the
result replaces. Ids are whole numbers. The input must give the same rows in the same partitions when it is read again, as a
file scan does; pass ``stable=False`` for other plans, which are checkpointed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, checkpointed, mix64, own_names, pieces

HASHES = 3
#: Cells of the fingerprint: 3 parts of 8.
CELLS = 24
GROW = 4
#: A cell as bytes: count (4), key (8), check (4), little-endian.
CELL_BYTES = 16

CUT = re.compile(r"[^\n.!?,;:|]+[.!?,;:|]*")
LONG = 160


def paragraphs(text: str) -> set[bytes]:
    out = set()
    for piece in CUT.findall(text):
        piece = piece.strip()
        if len(piece) > LONG:
            out.update(p.encode("utf-8", "surrogatepass") for p in soft_cut(piece))
        elif piece:
            out.add(piece.encode("utf-8", "surrogatepass"))
    return out


def soft_cut(piece: str) -> Iterator[str]:
    """Pieces of 24 to 160 characters that end behind a word chosen by its last letter's code point."""
    a = 0
    for i in range(len(piece)):
        n = i - a + 1
        if n >= LONG or (n >= 24 and piece[i] == " " and ord(piece[i - 1]) % 3 == 0):
            if s := piece[a : i + 1].strip():
                yield s
            a = i + 1
    if s := piece[a:].strip():
        yield s


def digests(text: str | None) -> np.ndarray:
    """The distinct 64-bit digests of a text's paragraphs, sorted."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((h(p) for p in paragraphs(text or "")), U64))


def cells_of(keys: np.ndarray, base: np.ndarray, part: np.ndarray, level: int) -> list[np.ndarray]:
    """The cell of each key in each of the parts (``part`` cells each) of its own table, which starts at ``base``."""
    return [base + j * part + (mix64(keys, 16 * level + j) % part.astype(U64)).astype(np.int64) for j in range(HASHES)]


def check_of(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 1023) >> U64(32)).astype(np.uint32)


class Tables:
    """Sketches of many documents (or differences of two), end to end."""

    def __init__(self, parts: np.ndarray, level: int):
        self.part, self.level = parts.astype(np.int64), level
        self.base = np.concatenate(([0], np.cumsum(self.part * HASHES)))
        n = int(self.base[-1])
        self.count, self.key, self.check = np.zeros(n, np.int32), np.zeros(n, U64), np.zeros(n, np.uint32)

    def add(self, doc: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        check = check_of(keys)
        for at in cells_of(keys, self.base[doc], self.part[doc], self.level):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """-> doc, key, side (+1, -1) of every recovered digest, and which documents did not peel."""
        owner = np.repeat(np.arange(len(self.part)), self.part * HASHES)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(self.count)
        for _ in range(64 + 4 * len(self.part).bit_length() + int(self.part.max(initial=1))):
            pure = look[np.abs(self.count[look]) == 1]
            pure = pure[check_of(self.key[pure]) == self.check[pure]]
            if not len(pure):
                break
            doc, key, side = owner[pure], self.key[pure].copy(), self.count[pure].copy()
            _, one = np.unique(mix64(key) ^ mix64(doc.astype(U64), 77), return_index=True)
            doc, key, side = doc[one], key[one], side[one]
            got.append((doc, key, side))
            self.add(doc, key, -side)
            look = np.unique(np.concatenate(cells_of(key, self.base[doc], self.part[doc], self.level)))
        bad = np.zeros(len(self.part), bool)
        bad[owner[(self.count != 0) | (self.key != 0) | (self.check != 0)]] = True
        if not got:
            z = np.zeros(0, np.int64)
            return z, np.zeros(0, U64), z, bad
        d, k, s = (np.concatenate(x) for x in zip(*got))
        return d, k, s, bad


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return doc, np.concatenate(sets) if sets else np.zeros(0, U64)


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """The smallest sketch of each text, as text."""
    t = Tables(np.full(len(sets), CELLS // HASHES), 0)
    t.add(*flat(sets), 1)
    rows = np.zeros((len(sets) * CELLS, CELL_BYTES), np.uint8)
    rows[:, :4] = t.count.astype("<u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4:12] = t.key.astype("<u8").view(np.uint8).reshape(-1, 8)
    rows[:, 12:] = t.check.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = rows.reshape(len(sets), -1)
    return [base64.b64encode(r.tobytes()).decode() for r in data]


def difference(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the digests of only a and of only b, by subtracting sketches and peeling, larger where that fails."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, U64),) * 2] * len(a)
    left, part, level = np.arange(len(a)), np.full(len(a), CELLS // HASHES), 0
    while len(left):
        t = Tables(part[left], level)
        t.add(*flat([a[i] for i in left]), 1)
        t.add(*flat([b[i] for i in left]), -1)
        doc, key, side, bad = t.peel()
        order = np.argsort(doc, kind="stable")
        doc, key, side = doc[order], key[order], side[order]
        edge = np.searchsorted(doc, np.arange(len(left) + 1))
        for n, i in enumerate(left):
            if not bad[n]:
                k, s = key[edge[n] : edge[n + 1]], side[edge[n] : edge[n + 1]]
                out[i] = k[s > 0], k[s < 0]
        left, level = left[bad], level + 1
        # a sketch of the smallest size has failed: go to a size that holds all digests of both versions or grow
        need = np.array([len(a[i]) + len(b[i]) for i in left], np.int64)
        part[left] = np.maximum(part[left] * GROW, need // 2 + 4) if level == 1 else part[left] * GROW
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared over all digests, from the recovered difference and the number of digests of a."""
    out = np.ones(len(a))
    for i, (x, y) in enumerate(difference(a, b)):
        union = len(a[i]) + len(y)
        out[i] = (len(a[i]) - len(x)) / union if union else 1.0
    return out


# ---------------------------------------------------------------- every document and the next one

RESULT = T.StructType(
    [
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def compared(texts: list[str], following: list[str]) -> pd.DataFrame:
    new = [edited(t, f) for t, f in zip(texts, following)]
    a, b, c = [digests(t) for t in texts], [digests(t) for t in new], [digests(t) for t in following]
    return pd.DataFrame(
        {
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
            "fingerprint": fingerprints(a),
            "edited_fingerprint": fingerprints(b),
            "near_edited": likeness(a, b),
            "near_next": likeness(a, c),
        }
    )


#: Bytes of text in a run, about, and runs at most: their bounds (a fixed number of bytes each) are what passes the driver.
RUN_BYTES, MOST_RUNS = 12 << 20, 1 << 17


def order_key(ids: pd.Series, ties: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Place of rows in the order as bytes that compare alike: null ids first, then the id, then two tie-breakers."""
    null = ids.isna().to_numpy()
    out = np.zeros((len(ids), 25), np.uint8)
    out[:, 0] = ~null
    for k, x in enumerate((ids.fillna(0).to_numpy(np.int64), ties.astype(np.int64), rows.astype(np.int64))):
        out[:, 1 + 8 * k : 9 + 8 * k] = (x.view(U64) ^ U64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(out).view("S25").ravel()


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bytes: int | None = None) -> tuple[DataFrame, int, dict[str, str]]:
    """Deal rows into runs of the order (id descending, nulls last, then hash of the text, then row), each with a copy of
    the next run's first row.

    The places of the runs' first rows are found beforehand from ids, hashes and row numbers alone: they are range-sorted
    and each partition's largest is a bound. A bound is a row's own place, so that row is known to be first in its run and
    is sent to the run before as well. Rows of one id, of no id and repeated rows are cut like all others.
    """
    names = own_names(df, "run", "tail", "t", "h", "r")
    run, tail, text, tie, row = (names[k] for k in ("run", "tail", "t", "h", "r"))
    rows = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumns({tie: F.xxhash64(text), row: F.monotonically_increasing_id()})
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col) + 16), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    runs = min(MOST_RUNS, max(1, size.n), pieces(max(size.b, 16 * size.n), run_bytes or RUN_BYTES))
    placed = rows.select(F.col(id_col).cast("long").alias("i"), F.col(tie).alias("h"), F.col(row).alias("r")).repartitionByRange(runs, F.col("i").asc_nulls_first(), "h", "r")
    top = placed.groupBy(F.spark_partition_id()).agg(F.max(F.struct(F.col("i").isNotNull().alias("known"), "i", "h", "r")).alias("m"))
    found = [r.m for r in top.collect()]
    bounds = np.sort(order_key(pd.Series([m.i for m in found], dtype="Int64"), np.array([m.h for m in found], np.int64), np.array([m.r for m in found], np.int64)))
    runs, shipped = max(1, len(bounds)), df.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("struct<run:int,first:boolean>")
    def place(ids: pd.Series, ties: pd.Series, rows: pd.Series) -> pd.DataFrame:  # binary search: the run of a row, and whether it is the run's first
        key = order_key(ids, ties.to_numpy(), rows.to_numpy())
        at = np.minimum(np.searchsorted(shipped.value, key, side="left"), runs - 1)
        return pd.DataFrame({"run": (runs - 1 - at).astype("int32"), "first": shipped.value[at] == key})

    # a run's first row also ends the run before it; the first run's ends the last
    rows = rows.withColumn("_p", place(F.col(id_col).cast("long"), F.col(tie), F.col(row)))
    at = lambda r, x: F.struct(r.alias("r"), F.lit(x).alias("x"))
    of = F.col("_p.run")
    both = F.when(F.col("_p.first"), F.array(at(of, False), at(F.pmod(of - 1, F.lit(runs)), True))).otherwise(F.array(at(of, False)))
    dealt = rows.withColumn("_q", F.explode(both)).withColumns({run: F.col("_q.r"), tail: F.col("_q.x")}).drop("_p", "_q")
    return dealt.repartitionById(runs, F.col(run)).sortWithinPartitions(run, tail, *[o.desc_nulls_last() for o in (F.col(id_col).cast("long"), F.col(tie), F.col(row))]), runs, names


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = 512, stable: bool = True) -> DataFrame:
    """Every document against its edited text and against the next document (descending id; after the last: the first)."""
    if not stable:
        df = checkpointed(df)
    dealt, _, names = with_next(df, id_col, text_col)
    run, tail, text = names["run"], names["tail"], names["t"]
    keep = [c for c in df.columns if c != text_col and c.lower() not in RESULT.names]
    dealt = dealt.select(*[F.col(f"`{c}`") for c in keep], run, tail, F.col(text))
    schema = T.StructType([*[df.schema[c] for c in keep], *RESULT.fields])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # a row whose next row has not come yet

        def done(part: pd.DataFrame, following: list[str]) -> Iterator[pd.DataFrame]:
            for a in range(0, len(part), chunk):
                p = part.iloc[a : a + chunk]
                res = compared(list(p[text]), following[a : a + chunk])
                yield pd.concat([p[keep].reset_index(drop=True), res], axis=1)

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            runs, tails, texts = frame[run].to_numpy(), frame[tail].to_numpy(), list(frame[text])
            same = np.r_[runs[1:] == runs[:-1], False]
            ready = np.flatnonzero(~tails & same)
            yield from done(frame.iloc[ready], [texts[i + 1] for i in ready])
            held = frame.iloc[[len(frame) - 1]] if len(frame) and not tails[-1] else None
            stray = np.flatnonzero(~tails & ~same)
            if len(stray) and stray[0] != len(frame) - 1:
                raise ValueError("a run without its tail: the input changed between readings; pass stable=False")
        if held is not None:
            raise ValueError("a run without its tail: the input changed between readings; pass stable=False")

    return dealt.mapInPandas(work, schema)
