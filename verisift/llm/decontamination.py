"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Words are maximal runs of letters a-z, digits and non-ASCII bytes after lower-casing A-Z. A window is 13 consecutive
words of a benchmark item (an item of 1 to 12 words is one window). The automaton runs over word numbers (words that no
window holds are 0), so a text is scanned once; every hit is mapped back to code-point offsets of the original text.

Scale: documents are never shuffled and nothing grows with them. The automaton is built once a worker process from
windows of at most about ``MOST_WORDS`` words (about 100 bytes each), the memory bound of driver and workers. A larger benchmark
is cut by window into pieces; the documents pass them one after the other, written between two passes with the items and
word ranges found so far, so that one automaton is held at a time and results are the same.

Defined results: null or wordless text has no hits; items without words or without an id are no items; an id that
occurs twice owns the windows of all its rows; a window that several items share is a hit for each; equal rows get
equal results; extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, own_names, pieces

WINDOW = 13
#: Window words in one automaton, about.
MOST_WORDS = 2_000_000
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

#: What the passes hand on: items and word ranges found so far.
FOUND = T.StructType(
    [
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))),
    ]
)
HIT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


def words(text: bytes) -> list[bytes]:
    return WORDS.findall(text.lower())


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window): the distinct windows of each item, as arrays of words."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), found.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("window")).distinct()


class WindowAutomaton:
    """Aho-Corasick over the word numbers of windows; each window knows its length and its items."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], tuple[str, ...]]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, items in windows:
            key = tuple(self.number.setdefault(x, len(self.number) + 1) for x in w)
            self.auto.add_word(key, (len(key), items))
        if windows:
            self.auto.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[set[str], list[tuple[int, int]]]:
        """-> items with an occurring window, and the merged word ranges [a, b) that windows cover."""
        number = self.number.get
        ids = [number(w, 0) for w in found]
        items: set[str] = set()
        spans: list[tuple[int, int]] = []
        if len(self.number) == 0 or not any(ids):
            return items, spans
        for end, (n, owners) in self.auto.iter(tuple(ids)):
            items.update(owners)
            spans.append((end - n + 1, end + 1))
        return items, merged(spans)


_BUILT: dict[str, WindowAutomaton] = {}


def built(name: str, shipped: Broadcast) -> WindowAutomaton:
    """The automaton of a broadcast list of windows, built once a process; the last one only is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = WindowAutomaton(shipped.value)
    return _BUILT[name]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Word ranges -> code-point offsets in the original text."""
    if not spans:
        return []
    at = [m.span() for m in WORDS.finditer(text.lower())]
    out, seen, chars = [], 0, 0
    for a, b in spans:
        start, end = at[a][0], at[b - 1][1]
        chars += len(text[seen:start].decode("utf-8", "replace"))
        first = chars
        chars += len(text[start:end].decode("utf-8", "replace"))
        out.append({"start": first, "end": chars})
        seen = end
    return out


def mark_contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """Add n_words, n_hit, n_items, item_ids (sorted strings), hit_spans (code points) and contaminated.

    A document is contaminated if n_hit > 0 and 20 * n_hit >= n_words.
    """
    sc = documents.sparkSession.sparkContext
    windows = item_windows(benchmark, id_col, item_text_col).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    total = windows.agg(F.coalesce(F.sum(F.size("window")), F.lit(0)).alias("n")).first().n
    n = pieces(total, most_words)
    if n > 1:
        windows = checkpointed(windows)
    names = own_names(documents, "text", "found", "hit")
    text, found, hit = names["text"], names["found"], names["hit"]
    done = documents.withColumn(text, F.col(text_col).cast("binary")).withColumn(found, F.lit(None).cast(FOUND))
    for part in range(n):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == part).collect() if total else []
        shipped = sc.broadcast([(tuple(w.encode() for w in r.window), tuple(r["items"])) for r in rows])
        done = _pass(done, shipped, text, found, hit, last=part == n - 1)
        if part < n - 1:
            done = checkpointed(done)
            shipped.unpersist()
    new = {k: F.col(hit)[k] for k in HIT.names}
    new["contaminated"] = (F.col(hit).n_hit > 0) & (F.col(hit).n_hit * 20 >= F.col(hit).n_words)
    return done.withColumns(new).drop(hit)


def _pass(documents: DataFrame, shipped: Broadcast, text_col: str, found_col: str, hit_col: str, last: bool) -> DataFrame:
    """One automaton over all texts. The last pass makes ``hit_col`` of text and findings, the others add to the findings."""
    own, name = [f for f in documents.schema.fields if f.name not in (text_col, found_col)], uuid4().hex
    out_type = T.StructType([*own, T.StructField(hit_col, HIT)] if last else [*own, T.StructField(text_col, T.BinaryType()), T.StructField(found_col, FOUND)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        auto, schema = built(name, shipped), to_arrow_schema(out_type)
        for batch in batches:
            rows = []
            for value, before in zip(batch.column(text_col), batch.column(found_col)):
                text, seen = value.as_py() or b"", before.as_py() or {"items": [], "spans": []}
                found = words(text)
                items, spans = auto.scan(found)
                items, spans = sorted(items.union(seen["items"])), merged(spans + [(x["a"], x["b"]) for x in seen["spans"]])
                if last:
                    rows.append({"n_words": len(found), "n_hit": sum(b - a for a, b in spans), "n_items": len(items), "item_ids": items, "hit_spans": original_spans(text, spans)})
                else:
                    rows.append({"items": items, "spans": [{"a": a, "b": b} for a, b in spans]})
            kept = [batch.column(f.name).cast(schema.field(f.name).type) for f in own]
            made = pa.array(rows, schema.field(hit_col if last else found_col).type)
            yield pa.RecordBatch.from_arrays([*kept, made] if last else [*kept, batch.column(text_col).cast(schema.field(text_col).type), made], schema=schema)

    return documents.mapInArrow(scan, out_type)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns (clashing names are safe)."""
    names = own_names(documents, "text", "doc")
    inner = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(names["doc"]), F.col(f"`{text_col}`").alias(names["text"]))
    marked = mark_contamination(inner, benchmark, names["text"])
    return marked.where(~F.col("contaminated")).select(f"{names['doc']}.*")


