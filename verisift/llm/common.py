"""Helpers shared by the corpus operators: 64-bit mixing, packed word scans, input sizing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialise import checkpointed, shared_folder  # noqa: F401

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_M1 = U64(0xBF58476D1CE4E5B9)
_M2 = U64(0x94D049BB133111EB)


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply); another salt is another function."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x += _ODD * U64(2 * salt + 1)
        x ^= x >> U64(30)
        x *= _M1
        x ^= x >> U64(27)
        x *= _M2
        x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(df: DataFrame, *wanted: str) -> dict[str, str]:
    """For helper columns: names that no input column has (case-blind, as Spark resolves them)."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for w in wanted:
        name = f"__{w}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out[w] = name
    return out


def pieces(total: float, each: float, least: int = 1) -> int:
    """How many pieces of about ``each`` make ``total``."""
    return max(least, math.ceil(total / max(each, 1)))


def text_bytes(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of text) of a table; one narrow aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return int(row.n), int(row.b)


# ---------------------------------------------------------------- packed word scan


class WordScan:
    """Vectorised word hashing over many texts laid end to end.

    Words are maximal runs of bytes that are none of space, tab, LF, VT, FF, CR; A-Z count as a-z. A word's hash is
    its polynomial over 2**64 (a prefix sum, divided by the power at its start) put through ``mix64``.
    """

    def __init__(self, most_bytes: int = 1 << 22):
        self.size = 0
        self._grow(most_bytes)

    def _grow(self, n: int) -> None:
        p = pow(0x5851F42D4C957F2D, 1, 1 << 64)
        inv = pow(p, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.pw = np.cumprod(np.concatenate(([U64(1)], np.full(n, p, U64))), dtype=U64)
            self.ipw = np.cumprod(np.concatenate(([U64(1)], np.full(n, inv, U64))), dtype=U64)
        self.size = n

    def __call__(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """buf: uint8 of all texts; starts: where each begins, with the end last. -> word hashes, words before each text."""
        n = len(buf)
        if n == 0:
            return np.zeros(0, U64), np.zeros(len(starts), np.int64)
        if n > self.size:
            self._grow(n)
        low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:n]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        with np.errstate(over="ignore"):
            total = np.concatenate(([U64(0)], np.cumsum((low.astype(U64) + U64(1)) * self.pw[:n], dtype=U64)))
            h = mix64((total[e] - total[s]) * self.ipw[s])
        return h, np.searchsorted(s, starts)


def slices(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut a run of texts into slices of at most ``most`` bytes, a longer text alone."""
    out, a, size = [], 0, 0
    for i, n in enumerate(lengths):
        if i > a and size + n > most:
            out.append((a, i))
            a, size = i, 0
        size += int(n)
    if a < len(lengths):
        out.append((a, len(lengths)))
    return out


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow binary/string array -> its bytes as uint8 and the offsets of each value (nulls are empty)."""
    import pyarrow as pa

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder as Parquet and read again: smaller than a checkpoint, which holds plain rows."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a key filter at most (16 MB), and so many for each key below that.
FILTER_BITS, BITS_A_KEY = 1 << 27, 16


def may_be_among(df: DataFrame, key: Column, keys: DataFrame, n: int, name: str) -> DataFrame:
    """Adds ``name``: false only where ``key`` is none of ``keys`` (one column, about n rows, of the key's type), or null.

    A bitmap over hashes, made by Spark in words of 4 KB and broadcast; its size is bounded, so more keys make it less sharp but
    never wrong. An exact join of the rows that are left follows it, so that the others need not be shuffled.
    """
    bits = min(FILTER_BITS, 1 << max(15, math.ceil(math.log2(max(n, 1) * BITS_A_KEY))))
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    word, place = (lambda c: F.shiftright(slot(c), 15)), (lambda c: slot(c).bitwiseAND(F.lit(32767)))
    own = own_names(df, "word", "bitmap")
    only = F.col(f"`{keys.columns[0]}`")
    bitmap = keys.where(only.isNotNull()).groupBy(word(only).alias(own["word"])).agg(F.bitmap_construct_agg(place(only)).alias(own["bitmap"]))
    byte = F.conv(F.hex(F.substring(F.col(own["bitmap"]), F.shiftright(place(key), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.pow(F.lit(2), place(key).bitwiseAND(F.lit(7))).cast("int")
    held = key.isNotNull() & (byte.bitwiseAND(mask) != 0)
    marked = df.withColumn(own["word"], word(key)).join(F.broadcast(bitmap), own["word"], "left")
    return marked.withColumn(name, F.coalesce(held, F.lit(False))).drop(*own.values())
