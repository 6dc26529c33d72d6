import base64
import hashlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verisift.llm import common, queries, warc

ROWS = [
    (1, "http://www.A.com/x?q=1", "<p>one</p>"), (2, "https://a.com:8080/y", "<p>one</p>"), (3, "http://b.org/\r\nz", "has \r\n\r\n inside\r\n\r\n"), (4, None, None), (5, "http://b.org/e", ""),
    (6, "not a url", "é日本"), (6, "not a url", "é日本"), (None, "http://a.com/n", "<p>one</p>"), (7, "http://www.a.com/x?q=1", "x" * 100_000), (8, "http://www.a.com/x?q=1", "<p>two</p>"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = "page_id long, url string, html string"


def archived(spark, rows, path, parts=3, block_lines=3):
    pages = spark.createDataFrame(rows, PAGES).repartition(parts)
    warc.write_archives(pages, path, stable=False)
    placed = warc.scan_heads(spark, path).cache()
    warc.write_index(placed, path, len(rows), block_lines=block_lines)
    return pages, placed


def keys(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(warc.stored_url(F.col("u"))).alias("key"))


def test_round_trip_through_the_index(spark, tmp_path):
    path = str(tmp_path / "w")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pages, placed = archived(spark, ROWS, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.count() == len(ROWS) and placed.select("file").distinct().count() > 1
    found = warc.look_up(keys(spark, [u for _, u, _ in ROWS]), path).cache()
    assert sorted((r.file, r.offset, r.length) for r in found.collect()) == sorted((r.file, r.offset, r.length) for r in placed.collect())
    got = warc.read_records(found, path).collect()
    top = {}
    for i, _, h in ROWS:
        top[digest(h)] = max(top.get(digest(h), -1), -1 if i is None else i)
    by = {}
    for r in got:
        by.setdefault(r.digest, []).append(r)
    for h in {h or "" for _, _, h in ROWS}:
        rows = by[digest(h)]
        first = [r for r in rows if r.record_type == "response"]
        assert len(first) == 1 and bytes(first[0].payload).decode() == h and (first[0].page_id if first[0].page_id is not None else -1) == top[digest(h)]
        assert all(r.refers_to == top[digest(h)] and len(r.payload) == 0 for r in rows if r.record_type == "revisit")
    hits = warc.look_up(keys(spark, ["HTTP://www.a.com/x?q=1"]), path)
    records = warc.read_records(hits, path).collect()
    assert sorted(r.page_id for r in records) == [1, 7, 8] and b"<p>two</p>" in [bytes(r.payload) for r in records]
    one = warc.look_up(keys(spark, ["http://nowhere.net/", "http://a.com/n", "", "zzz", None, "http://a.com/n"]), path).collect()
    assert [r.key for r in one if r.key] == ["com,a)/n"] and len(one) == 2  # and the null URL's record


def test_hot_url_over_many_parts_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "pieces", lambda total, each, least=1: 6)
    rows = [(i, f"http://{'hot.org/x' if i % 3 else f'h{i % 7}.net/{i}'}", f"<p>{i % 50}</p>" * (1 + i % 40)) for i in range(400)]
    path = str(tmp_path / "w")
    archived(spark, rows, path, parts=5)
    table = warc.index_table(spark, path)
    firsts = [r.first_key for r in table.collect()]
    assert table.select("part").distinct().count() > 2 and firsts.count("org,hot)/x") > 3 and max(r.lines for r in table.collect()) <= 3
    hot = warc.read_records(warc.look_up(keys(spark, ["http://hot.org/x"]), path), path).collect()
    assert sorted(r.page_id for r in hot) == [i for i in range(400) if i % 3]
    rest = warc.look_up(keys(spark, [u for _, u, _ in rows if "hot" not in u] + ["http://hot.org/", "http://hot.org/y"]), path)
    assert sorted(r.page_id for r in warc.read_records(rest, path).collect()) == [i for i in range(400) if i % 3 == 0]


def test_heads_are_found_in_pieces(tmp_path):
    long = "u" * 5000
    made, want = b"", []
    for i, n in enumerate((0, 7, 70_000, 300)):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + b"\r\n\r\n"[: n % 5] + b"x" * n
        head = f"WARC/1.1\r\nWARC-Target-URI: {long if i == 2 else i}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        want.append((len(made), len(head) + len(block)))
        made += head + block + b"\r\n\r\n"
    (tmp_path / "a.txt").write_bytes(made)
    files = warc.Files(str(tmp_path))
    for piece in (16, 300, 1 << 18):
        assert [(h.offset, h.length) for h in warc.heads(files.open("a.txt"), piece)] == want
    assert warc.payload_of(files.range("a.txt", *want[1]))[1] == b"\r\n" + b"x" * 7
    (tmp_path / "b.txt").write_bytes(made[: want[0][1] + 20])
    with pytest.raises(ValueError):
        list(warc.heads(files.open("b.txt"), 16))


def test_registered_query_equals_its_sql(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op4_warc(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.OP4).df()
    plain = lambda d: sorted(str(tuple(None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_keys(spark):
    urls = ["http://www.A.com:80/x?q=1", "http://user@h.example/", "ftp://x.y:1/z#f", "", None, "not a url", "http://b.org/\r\nz"]
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.k for r in d.select(warc.url_key(warc.stored_url(d.u)).alias("k")).collect()]
    assert got == ["com,A,www)/x?q=1".lower(), "example,h)/", "y,x)/z#f", "", "", "not a url", "org,b)/%0D%0Az"]
    for r in d.select("u", warc.base32_sha1(F.coalesce(d.u, F.lit("")).cast("binary")).alias("s")).collect():
        assert r.s == digest(r.u)


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], PAGES)
    assert warc.records(pages).count() == 0
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op4_warc(spark, str(tmp_path)).count() == 0


def test_payloads_that_occur_once_are_not_shuffled(spark):
    rows = [(i, f"http://a.com/{i}", f"<p>{i}</p>") for i in range(200)]
    plan = lambda r: warc.records(spark.createDataFrame(r, PAGES))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan(rows)
    mixed = plan([*rows, (900, None, "<p>7</p>")])
    assert "Union" in mixed and "bitmap" in mixed


def test_key_filter_drops_no_key(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 15)
    keys_ = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    d = spark.range(3001).select(F.when(F.col("id") < 3000, F.concat(F.lit("k"), F.col("id"))).alias("x"))
    got = {r.x: r.hit for r in common.may_be_among(d, F.col("x"), keys_, 1000, "hit").collect()}
    assert len(got) == 3001 and all(got[f"k{i}"] for i in range(0, 3000, 3)) and not got[None]
    assert sum(got.values()) < 1400  # one in 33 of the others, about
