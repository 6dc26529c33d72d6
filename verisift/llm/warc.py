"""WARC archives with a two-level capture index.

Archives are plain WARC 1.1 files that Spark's text writer lays down on any file system (the record separator is the
line separator). Records of equal payloads are stored once: the largest page id is the response, the others are
revisits that refer to it. ``scan_heads`` walks an archive from head to head by the records' own lengths.

The index maps a URL's key (host labels reversed, then path) to (file, offset, length). Lines are range-sorted by key
and cut into compressed blocks; a sparse directory keeps the first key of each block, and a top level the first key of
each index part (at most ``MOST_PARTS`` keys, whatever the data). ``look_up`` takes any number of keys: each is bisected
in the top level, goes to its part, is bisected in that part's directory, meets the block it may lie in and is bisected
in the block's lines. ``read_records`` sorts what was found by place and range-reads the records, one open file at a time.

Scale: the payload is hashed where it lies; the choice of the response is a map-side combined aggregate by digest, so a
payload that a third of all pages share costs one row a task. Digests that occur twice are written; pages whose digest is
not among them (by a bitmap of bounded size) are written where they lie, the others go through an equi-join Spark may split. No task
holds a file: heads are read in pieces, records one by one. The index is range-partitioned by (key, file, offset), so a
hot URL does not make a hot part: it is looked up once and found in all parts and blocks that hold it.

Defined results: null html is the empty payload; a null url has no target line and the empty key; a null page id sorts
below all others and stays null; of repeated rows with the largest id one is the response; CR and LF in a url are
percent-encoded; captures of one key come in no set order; a key without captures finds nothing; extra columns do not
go into the archive. The input must give the same rows in the same partitions when it is read again, as a file scan
does; pass ``stable=False`` for other plans, which are checkpointed.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, may_be_among, pieces, written

CRLF = "\r\n"
#: Records in one file at most, lines in one index block, index parts at most, bytes read by one task.
FILE_RECORDS, BLOCK_LINES, MOST_PARTS, TASK_BYTES = 10_000, 500, 1 << 16, 64 << 20
#: RFC 4648 letters, in the order of the digits of base 32. Fixed values.
BASE32_DIGITS, BASE32_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: 4 times 40 bits, each written with 8 digits of base 32."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32_LETTERS)


def url_key(url: Column) -> Column:
    """Reversed host labels, then the rest: http://www.a.com/x -> com,a,www)/x (lower-case host, no scheme, no port)."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(F.length(host) > 0, F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(u)


def stored_url(url: Column) -> Column:
    """A URL as the archive holds it."""
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", stable: bool = True) -> DataFrame:
    """One column ``value``: the WARC record of every page."""
    if not stable:
        pages = checkpointed(pages.select(id_col, url_col, html_col))
    base = pages.select(
        F.col(id_col).cast("long").alias("id"),
        stored_url(F.col(url_col)).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    first = base.groupBy("digest").agg(F.max(F.struct("id", "row", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = written(first.where("n > 1").select("digest", "first"), "repeated")
    n = repeated.count()
    r = base.withColumn("first", F.lit(None).cast(repeated.schema["first"].dataType))
    if n:  # only payloads that may occur twice are shuffled
        marked = may_be_among(base, F.col("digest"), repeated.select("digest"), n, "again")
        alone = marked.where("NOT again").drop("again").withColumn("first", F.lit(None).cast(repeated.schema["first"].dataType))
        r = alone.unionByName(marked.where("again").drop("again").join(repeated, "digest", "left"))
    response = F.col("first").isNull() | (F.col("row") == F.col("first.row"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise(http)
    uuid = lambda *c: F.regexp_replace(F.md5(F.concat_ws("|", *c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    own = uuid(F.col("id").cast("string"), F.col("row").cast("string"), F.col("digest"))
    other = uuid(F.col("first.id").cast("string"), F.col("first.row").cast("string"), F.col("digest"))
    revisit = F.concat(
        F.lit(f"WARC-Profile: {PROFILE}{CRLF}"), F.lit("WARC-Refers-To: "), other, F.lit(CRLF),
        line("WARC-Refers-To-Target-URI", F.col("first.url")), line("X-Refers-To-Page", F.col("first.id").cast("string")),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(response, "response").otherwise("revisit"), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Record-ID: "), own, F.lit(CRLF),
        line("WARC-Target-URI", F.col("url")), line("X-Page", F.col("id").cast("string")), F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF),
        F.when(response, F.lit("")).otherwise(revisit),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF),
    )
    return r.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    records(pages, **options).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", FILE_RECORDS).text(f"{path}/warc")


def frame(rows: list[tuple], names: str) -> pd.DataFrame:
    """Rows as plain objects, which Arrow converts by the declared schema."""
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names.split())})


# ---------------------------------------------------------------- files, in tasks


class Files:
    """The files of one folder, opened in a task by the file system their address names; one is open at a time."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", folder if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", folder) else f"file:{folder}"))
        self.name = self.file = None

    def open(self, name: str):
        if name != self.name:
            self.close()
            self.file, self.name = self.fs.open_input_file(f"{self.root}/{name}"), name
        return self.file

    def range(self, name: str, offset: int, length: int) -> bytes:
        return self.open(name).read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None


@dataclass
class Head:
    offset: int
    length: int
    headers: dict[str, str]


def headers_of(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record: {lines[0][:40]!r}")
    return dict(x.split(": ", 1) for x in lines[1:])


def heads(file, piece: int = 1 << 18) -> Iterator[Head]:
    """The record heads of an open archive: each is found behind the record before it; payloads are passed over."""
    size, at, base, held = file.size(), 0, 0, b""
    while at < size:
        end = held.find(b"\r\n\r\n", at - base) if at - base < len(held) else -1
        if end < 0:  # read on from the record's start, twice as much if the head is longer than that
            want = piece if at != base else max(piece, 2 * len(held))
            if at == base and len(held) >= size - at:
                raise ValueError(f"a head without an end at byte {at}")
            base, held = at, file.read_at(min(want, size - at), at)
            continue
        headers = headers_of(held[at - base : end])
        stop = base + end + 4 + int(headers["Content-Length"])
        yield Head(at, stop - at, headers)
        at = stop + 4


def payload_of(record: bytes) -> tuple[dict[str, str], bytes]:
    """One record, as range-read: its headers and payload."""
    end = record.index(b"\r\n\r\n")
    return headers_of(record[:end]), record[record.index(b"\r\n\r\n", end + 4) + 4 :]


def scan_heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, url) of every record of the archives."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = Files(f"{path}/warc")
        for listed in frames:
            for name in listed["file"]:
                out = [(name, h.offset, h.length, h.headers.get("WARC-Target-URI")) for h in heads(files.open(name))]
                for a in range(0, len(out), 10_000):
                    yield frame(out[a : a + 10_000], "file offset length url")
        files.close()

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/warc").select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return listed.mapInPandas(rows, "file string, offset long, length long, url string")


CAPTURE = "file string, offset long, record_type string, page_id long, url string, digest string, refers_to long, payload binary"


def read_records(captures: DataFrame, path: str) -> DataFrame:
    """captures: file, offset, length. The records at these places, range-read: headers and payload (empty for revisits)."""
    total = captures.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first().b
    placed = captures.select("file", "offset", "length").repartitionByRange(pieces(total, TASK_BYTES), "file", "offset").sortWithinPartitions("file", "offset")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, names = Files(f"{path}/warc"), " ".join(c.split()[0] for c in CAPTURE.split(", "))
        number = lambda x: None if x is None else int(x)
        for places in frames:
            out, size = [], 0
            for name, offset, length in places.itertuples(index=False):
                h, payload = payload_of(files.range(name, offset, length))
                out.append((name, offset, h["WARC-Type"], number(h.get("X-Page")), h.get("WARC-Target-URI"), h["WARC-Payload-Digest"].removeprefix("sha1:"), number(h.get("X-Refers-To-Page")), payload))
                size += len(payload)
                if size > 1 << 24:
                    yield frame(out, names)
                    out, size = [], 0
            if out:
                yield frame(out, names)
        files.close()

    return placed.mapInPandas(rows, CAPTURE)


# ---------------------------------------------------------------- the index


def write_index(captures: DataFrame, path: str, rows: int, block_lines: int = BLOCK_LINES) -> None:
    """captures: file, offset, length, url. Writes blocks (by part) and the directory with the first key of each."""
    lines = captures.select(url_key(F.col("url")).alias("key"), "file", "offset", "length")
    parts = min(MOST_PARTS, pieces(rows, 100 * block_lines))
    ordered = lines.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, pd.DataFrame()
        for lines in chain(frames, [None]):
            held = held if lines is None else pd.concat([held, lines], ignore_index=True)
            while len(held) >= block_lines or lines is None and len(held):
                cut, held = held.iloc[:block_lines], held.iloc[block_lines:]
                body = "\n".join(f"{k.encode('unicode_escape').decode()}\t{f}\t{o}\t{n}" for k, f, o, n in cut.itertuples(index=False))
                yield pd.DataFrame({"part": [part], "block": [number], "first_key": [cut["key"].iloc[0]], "lines": [len(cut)], "data": [zlib.compress(body.encode(), 6)]})
                number += 1

    made = ordered.mapInPandas(blocks, "part int, block int, first_key string, lines int, data binary")
    made.write.partitionBy("part").parquet(f"{path}/index")


def index_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("block int, first_key string, lines int, data binary, part int").parquet(f"{path}/index")


def lines_of(data: bytes) -> tuple[list[str], list[tuple[str, int, int]]]:
    """The keys of a block and the places they stand for."""
    lines = [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]
    return [k.encode().decode("unicode_escape") for k, *_ in lines], [(f, int(o), int(n)) for _, f, o, n in lines]


def reach(firsts: list[str], key: str) -> range:
    """Which stretches, by their sorted first keys, may hold a key: the one it falls into and those that begin with it."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def look_up(keys: DataFrame, path: str) -> DataFrame:
    """keys: one string column ``key``. (key, file, offset, length) of all captures of the distinct keys."""
    table = index_table(keys.sparkSession, path)
    tops = sorted((r.k, r.part) for r in table.groupBy("part").agg(F.min("first_key").alias("k")).collect())  # at most MOST_PARTS
    firsts, numbers = [k for k, _ in tops], [p for _, p in tops]

    @F.pandas_udf("array<int>")
    def parts(keys: pd.Series) -> pd.Series:
        return pd.Series([[numbers[i] for i in reach(firsts, k)] for k in keys], dtype=object)

    want = keys.where("key IS NOT NULL").select("key").distinct().select("key", F.explode(parts("key")).alias("part"))

    def in_directory(want: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
        if not len(want) or not len(directory):
            return frame([], "part block key")
        d = directory.sort_values("block")
        firsts, blocks = list(d["first_key"]), list(d["block"])
        hit = [(part, blocks[i], key) for part, key in zip(want["part"], want["key"]) for i in reach(firsts, key)]
        return frame(hit, "part block key")

    directory = table.select("part", "block", "first_key")
    in_part = want.groupBy("part").cogroup(directory.groupBy("part")).applyInPandas(in_directory, "part int, block int, key string")

    def in_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blocks in frames:
            for keys, data in zip(blocks["keys"], blocks["data"]):
                have, places = lines_of(data)
                out = [(k, *places[i]) for k in keys for i in range(bisect_left(have, k), bisect_right(have, k))]
                if out:
                    yield frame(out, "key file offset length")

    by_block = in_part.groupBy("part", "block").agg(F.collect_list("key").alias("keys")).join(table.select("part", "block", "data"), ["part", "block"])  # keys of one block
    return by_block.select("keys", "data").mapInPandas(in_block, "key string, file string, offset long, length long")
