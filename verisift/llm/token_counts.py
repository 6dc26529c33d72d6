"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For a pre-token (a piece that the vocabulary's split pattern cuts out) the table ``counts[i]`` holds the exact number
of tokens of its first ``i`` bytes. It is filled left to right: the last token ``t`` of a prefix is the one vocabulary
entry ending there for which the merges keep the pair (last token of the shorter prefix, ``t``) apart, so
``counts[i] = counts[i - len(t)] + 1``. A text is the running sum over its pieces; the sums at piece ends are stored,
so the count of any prefix, and the longest prefix under a budget, come from the store and one piece's table, without
encoding the text again.

Defined results: null or empty text has 0 bytes and 0 tokens; equal rows have equal counts; special strings inside a
text are one token each, as the library does by default; other columns pass through untouched.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, as the vocabulary's split pattern understands \s. Fixed values.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of white space with the run of other characters behind it: pieces never reach across such a chunk's end.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The split pattern of the vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct chunks, pieces and pairs remembered by one Python worker; beyond it a table is emptied, counts stay exact.
MEMORY = 900_000


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Exact token counts of prefixes for one vocabulary file (byte-level BPE, ``.json``)."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        letter = _byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if all(c in letter for c in t)}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.vocab))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces_of = regex.compile(PATTERN).findall
        self._chunk: dict[str, int] = {}
        self._piece: dict[str, int] = {}
        self._apart: dict[tuple[bytes, bytes], bool] = {}

    def _merged(self, data: bytes) -> list[bytes]:
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.rank
        while len(parts) > 1:
            best = min(((rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 30:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _keeps_apart(self, a: bytes, b: bytes) -> bool:
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) > MEMORY:
                self._apart.clear()
            known = self._apart[a, b] = self._merged(a + b) == [a, b]
        return known

    def table(self, data: bytes) -> list[int]:
        """counts[i]: tokens of ``data[:i]``, for one piece."""
        vocab, longest = self.vocab, self.longest
        counts, last = [0], [b""]
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                t = data[j:i]
                if t in vocab and (j == 0 or self._keeps_apart(last[j], t)):
                    counts.append(counts[j] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of {data[:40]!r}")
        return counts

    def _count_chunk(self, chunk: str) -> int:
        n = 0
        for piece in self.pieces_of(chunk):
            c = self._piece.get(piece)
            if c is None:
                if len(self._piece) > MEMORY:
                    self._piece.clear()
                c = self._piece[piece] = self.table(piece.encode())[-1]
            n += c
        if len(self._chunk) > MEMORY:
            self._chunk.clear()
        if len(chunk) < 64:
            self._chunk[chunk] = n
        return n

    def _segments(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """(start, segment, is it a special string)"""
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield at, text[at : m.start()], False
                yield m.start(), m[0], True
                at = m.end()
        if at < len(text):
            yield at, text[at:], False

    def count(self, text: str | None) -> int:
        n, known, slow = 0, self._chunk.get, self._count_chunk
        for _, part, special in self._segments(text or ""):
            if special:
                n += 1
                continue
            for chunk in CHUNK.findall(part):
                c = known(chunk)
                n += slow(chunk) if c is None else c
        return n

    def store(self, text: str | None) -> tuple[list[int], list[int]]:
        """(ends, counts): code points and exact tokens at the end of every chunk."""
        ends, counts, n = [], [], 0
        for at, part, special in self._segments(text or ""):
            for m in [None] if special else CHUNK.finditer(part):
                if special:
                    n, end = n + 1, at + len(part)
                else:
                    c = self._chunk.get(m[0])
                    n, end = n + (self._count_chunk(m[0]) if c is None else c), at + m.end()
                ends.append(end)
                counts.append(n)
        return ends, counts

    def at(self, text: str, ends: list[int], counts: list[int], length: int) -> int:
        """Exact tokens of ``text[:length]`` (its own encoding) from the store."""
        k = bisect_right(ends, length)
        at, n = (ends[k - 1], counts[k - 1]) if k else (0, 0)
        rest = text[at:length]
        if not rest:
            return n
        return n + sum(self.table(p.encode())[-1] for p in self.pieces_of(rest))

    def fit(self, text: str, ends: list[int], counts: list[int], budget: int) -> int:
        """Code points of the longest prefix whose count is at most ``budget``."""
        k = bisect_right(counts, budget)
        at, stop = ends[k - 1] if k else 0, ends[k] if k < len(ends) else len(text)
        return next((i for i in range(stop, at, -1) if self.at(text, ends, counts, i) <= budget), at)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary and Python worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(df: DataFrame, vocabulary: str, text_col: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """Add the UTF-8 bytes and the exact token count of every whole text."""

    @F.pandas_udf("long")
    def total(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary).count
        for s in texts:
            yield pd.Series([count(x) for x in s], dtype="int64")

    return df.withColumn(n_bytes, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).withColumn(n_tokens, total(F.col(text_col)))


def prefix_store(df: DataFrame, vocabulary: str, text_col: str = "text", name: str = "prefix") -> DataFrame:
    """Add a struct of two arrays: ``ends`` (code points) and ``counts`` (exact tokens of the text up to there)."""

    @F.pandas_udf("struct<ends:array<int>,counts:array<int>>")
    def stored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        store = counter(vocabulary).store
        for s in texts:
            yield pd.DataFrame([store(x) for x in s], columns=["ends", "counts"])

    return df.withColumn(name, stored(F.col(text_col)))


def truncate_to_budget(df: DataFrame, vocabulary: str, budget: int, text_col: str = "text", store_col: str = "prefix", name: str = "kept_chars") -> DataFrame:
    """With a prefix store in the table: how many code points fit into ``budget`` tokens."""

    @F.pandas_udf("int")
    def fits(texts: pd.Series, stores: pd.DataFrame) -> pd.Series:
        fit = counter(vocabulary).fit
        return pd.Series([fit(t or "", list(e), list(c), budget) for t, e, c in zip(texts, stores["ends"], stores["counts"])], dtype="int32")

    return df.withColumn(name, fits(F.col(text_col), F.col(store_col)))
