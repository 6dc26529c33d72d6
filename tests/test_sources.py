import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.operators import adapters, upsert
from verisift.sources import archive, readers


def test_paged_json(spark, tmp_path):
    row = T.StructType([T.StructField("PersonID", T.LongType()), T.StructField("FirstName", T.StringType())])
    (tmp_path / "a.json").write_text(json.dumps({"odata.metadata": "m", "value": [{"PersonID": 1, "FirstName": "x"}, {"PersonID": 2}], "odata.nextLink": "n"}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"value": [{"PersonID": 3}], "@odata.nextLink": "k", "@odata.count": "9"}))
    (tmp_path / "c.json").write_text(json.dumps({"error": 1}))
    (tmp_path / "d.json").write_text("{broken")
    rows, bad = readers.read_paged_json(spark, str(tmp_path / "*.json"), row)
    assert sorted((r.PersonID, r.next_link) for r in rows.collect()) == [(1, "n"), (2, "n"), (3, "k")]
    assert bad.count() == 2


def test_csv_bom(spark, tmp_path):
    (tmp_path / "v.csv").write_bytes("﻿vote_id,kmmbr_id,vote_result\n1,000012,1\n1,000000,9\n,3,1\n2,7,x\n".encode())
    d = readers.read_csv_dump(spark, str(tmp_path / "v.csv"))
    assert d.columns == ["vote_id", "kmmbr_id", "vote_result"] and {t for _, t in d.dtypes} == {"string"}
    v = adapters.votes(d.withColumn("kmmbr_name", F.lit("n")))
    assert sorted((r.value is None, r.value) for r in v.collect()) == [(False, "for"), (True, None), (True, None)]


def test_search_hits(spark, tmp_path):
    hit = lambda **k: {"source": {"id": "1", "title": "t", "policy_type": "החלטות ממשלה", **k}}
    (tmp_path / "s.json").write_text(json.dumps({"search_counts": {"_current": {"total_overall": 7}}, "search_results": [hit(government="הממשלה ה- 37", url_id="u", text=" x ", procedure_number_str="5"), hit(title=" "), hit(policy_type="other"), hit(id=None)]}))
    h = readers.read_search_hits(spark, str(tmp_path / "s.json"))
    d = adapters.government_decisions(h).collect()
    assert len(d) == 1 and d[0].government_number == 37 and d[0].summary == "x" and d[0].source_url.endswith("/u") and h.first().total_overall == 7


PAGE = """<table class="ResultsSummaryTable"><tr> <th>a</th></tr><tr><td>1,000</td><td>800</td><td>80.0%</td><td>790</td><td>10</td></tr></table>
<table><tbody><tr><th scope="row"></th><td> <b>Sun</b> </td><td>ab</td><td>7</td><td>50.63%</td><td><div class="FloatDir"> 400 </div></td></tr>
<tr><th scope="row"></th><td>Moon</td><td>cd</td><td>x</td><td>1%</td><td></td></tr><tr><th scope="row"></th><td>Star</td><td>ef</td><td>0</td><td>bad</td><td><div class="FloatDir">25</div></td></tr><tr><td>no</td></tr></tbody></table>"""


def test_result_pages(spark):
    pages = spark.createDataFrame([(25, "2022-11-01", PAGE), (25, "2022-11-01", "<p>nothing</p>")], "knesset_number int, election_date string, html string")
    r = readers.extract_result_tables(pages)
    got = {x.list_name: x for x in r.collect()}
    assert set(got) == {"Sun", "Star"} and (got["Sun"].valid_votes, got["Sun"].votes, got["Sun"].seats_won) == (790, 400, 7)
    mapping = spark.createDataFrame([(25, "ab", "11")], "knesset_number int, ballot_letters string, faction_id string")
    e = {x.list_name: x for x in adapters.election_results(r, mapping).collect()}
    assert e["Sun"].passed_threshold and not e["Star"].passed_threshold and e["Sun"].vote_share == 0.5063 and e["Star"].vote_share == 0.0 and e["Sun"].list_party_id != e["Star"].list_party_id
    with pytest.raises(Exception, match="no list mapping"):
        adapters.election_results(r.withColumn("knesset_number", F.lit(3)), mapping).collect()


def test_manifests_lookup_excerpt_payload(spark, tmp_path):
    good = {"family": "f", "adapter": "a", "source_url": "https://x", "source_tier": 1, "parser": "p", "cadence_cron": "* * * * *", "entity_hints": {"k": "v"}}
    (tmp_path / "m.json").write_text("\n".join(json.dumps(x) for x in (good, {**good, "source_tier": 9}, {**good, "source_url": "ftp"}, {"family": "f"})))
    ok, bad = readers.read_manifests(spark, str(tmp_path / "m.json"))
    assert ok.count() == 1 and bad.count() == 3
    (tmp_path / "s.jsonl").write_text('# note\n{"source_url":"u","source_family":"f","language":"he"}\n\n{"source_url":"u"}\n')
    assert readers.read_statement_manifest(spark, str(tmp_path / "s.jsonl")).count() == 1
    lk = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), (" ", "c", 3), ("2", "", 4)], "k string, v string, s int")
    assert [tuple(r) for r in readers.load_lookup(lk, "k", "v", F.col("s")).collect()] == [("1", "b")]
    d = spark.createDataFrame([("one\n two x \nthree x", "x"), ("  all ", "y"), (" all ", None)], "t string, a string")
    assert [r.e for r in d.select(readers.select_excerpt(F.col("t"), F.col("a")).alias("e")).collect()] == ["two x", "all", "all"]
    p = spark.createDataFrame([(bytearray(b"a\nbb\n\xffc"),)], "b binary")
    assert bytes(p.select(readers.truncate_payload(F.col("b"), 2, 3).alias("x")).first().x) == b"a\nb"


def test_archive_twice(spark):
    at = dt.datetime(2024, 2, 3, 1)
    rows = [(bytearray(b"x"), "text/html", "gov_il", "u1", at, 1, 1), (bytearray(b"x"), "text/html", "gov_il", "u2", at, 1, 2), (bytearray(b"y"), None, "gov_il", "u3", at, 1, 3)]
    f = spark.createDataFrame(rows, "content binary, content_type string, family string, source_url string, captured_at timestamp, source_tier int, seq int")
    empty = spark.createDataFrame([], "content_sha256 string, archive_uri string")
    a, fresh = archive.archive(f, empty)
    assert {r.seq: r.created for r in a.collect()} == {1: True, 2: False, 3: True} and fresh.count() == 2
    assert all(r.archive_uri.startswith("s3://archive/gov_il/2024/02/03/") and r.archive_uri.endswith((".html", ".bin")) for r in fresh.collect())
    again, none = archive.archive(f, fresh.select("content_sha256", "archive_uri"))
    assert none.count() == 0 and not again.where("created").count()
    uris = ["s3://b/gov_il/2024/02/30/" + "a" * 64 + ".bin", "s3://b/gov_il/2024/02/28/" + "a" * 64 + ".bin", "s3://b/none/2024/02/28/" + "a" * 64 + ".bin", "x", None]
    d = spark.createDataFrame([(u,) for u in uris], "u string").select(archive.parse_archive_uri(F.col("u")).alias("p"))
    assert [r.p.valid for r in d.collect()] == [False, True, False, False, False]


def test_adapters(spark):
    raw = spark.createDataFrame([(1, " דָּוִד ", "לוי", None), (2, None, "", True), (None, "x", "y", True)], "PersonID int, FirstName string, LastName string, IsCurrent boolean")
    p = {r.external_ids["knesset_person_id"]: r for r in adapters.people(raw).collect()}
    assert p["1"].canonical_name == "דוד לוי" and p["2"].canonical_name == "person:2" and not p["1"].is_current
    b = adapters.bills(spark.createDataFrame([(5, " t ", 24, 3), (6, None, None, None), (0, "z", 1, 1)], "BillID int, Name string, KnessetNum int, StatusID int")).collect()
    assert [(r.title, r.status) for r in b] == [("t", "status:3"), ("bill:6", None)]
    i = adapters.bill_initiators(spark.createDataFrame([(1, 2, 3, True, 1), (1, 2, 3, False, 1), (1, None, 3, True, 1)], "BillInitiatorID int, BillID int, PersonID int, IsInitiator boolean, Ordinal int"))
    assert i.count() == 1
    lookup = spark.createDataFrame([("10", "1")], "mk_individual_id string, PersonID string")
    c = adapters.committee_memberships(spark.createDataFrame([("10", "3", "c", "2020-01-01", None, "24"), ("11", "3", "c", "2020-01-01", None, "x"), ("10", "3", "c", None, None, "1")], "mk_individual_id string, committee_id string, committee_name string, start_date string, finish_date string, knesset string"), lookup)
    assert [r.knesset_number for r in c.collect()] == [24]
    s = spark.createDataFrame([(7, 3, "2020-01-01 10:00:00", '["10", "99", ""]'), (8, 3, "2020-01-02", "oops"), (9, None, None, "[]")], "CommitteeSessionID int, CommitteeID int, StartDate string, attended_mk_individual_ids string")
    ev, ed = adapters.attendance(s, lookup)
    assert ev.count() == 2 and ed.count() == 1


def test_statement_sink_and_spans(spark):
    st = spark.createDataFrame([("a", "t"), ("b", "t")], "statement_id string, text string")
    cl = spark.createDataFrame([("a", "1", None), ("b", "2", "checkable")], "statement_id string, claim_id string, checkability string")
    new, rows = archive.write_statements(st, cl, st.limit(0).union(st.where("statement_id = 'a'")), cl.limit(0))
    assert [r.statement_id for r in new.collect()] == ["b"] and {r.claim_id: r.checkability for r in rows.collect()} == {"1": "non_checkable", "2": "checkable"}
    docs = spark.createDataFrame([("d", "abc def abc", None)], "document_id string, body string, content_sha256 string")
    hit = archive.extract_spans(docs, spark.createDataFrame([("d", "def"), ("d", "zzz"), ("d", "")], "document_id string, anchor string")).collect()
    assert [(r.char_start, r.char_end) for r in hit] == [(4, 7)]


def test_run_lifecycle(spark):
    runs = archive.run_started(spark, "f", "a", "2024-01-01 00:00:00").unionByName(archive.run_started(spark, "f", "b", "2024-01-01 00:00:00"))
    assert {r.status for r in runs.collect()} == {"running"} and runs.where("finished_at is not null").count() == 0
    one, two = archive.run_id("f", "a", "2024-01-01 00:00:00"), archive.run_id("f", "b", "2024-01-01 00:00:00")
    stats = lambda **k: spark.createDataFrame(list(k.items()), "stat string, value long")
    runs = runs.withColumn("stats", F.when(F.col("run_id") == one, F.create_map(F.lit("pages"), F.lit("1"), F.lit("kept"), F.lit("7"))).otherwise(F.col("stats")))
    done = archive.run_finished(archive.run_finished(runs, one, stats(pages=3, upserted=9), "2024-01-01 00:01:00"), two, stats(pages=0), "2024-01-01 00:02:00", failed=True)
    again = archive.run_finished(done, one, stats(pages=99), "2025-01-01 00:00:00", failed=True)
    got = {r.adapter: r for r in again.collect()}
    assert (got["a"].status, got["a"].stats, got["a"].finished_at.year) == ("succeeded", {"pages": "3", "upserted": "9", "kept": "7"}, 2024)
    assert (got["b"].status, got["b"].stats) == ("failed", {"pages": "0"})


def test_payloads_and_report(spark, tmp_path):
    at = dt.datetime(2024, 2, 3, 1)
    rows = [(bytearray(b"x"), "text/html", "gov_il", "u1", at, 1, 1), (bytearray(b"x"), "text/html", "gov_il", "u2", at, 1, 2), (bytearray(b"y"), None, "gov_il", "u3", at, 1, 3)]
    f = spark.createDataFrame(rows, "content binary, content_type string, family string, source_url string, captured_at timestamp, source_tier int, seq int")
    _, fresh = archive.archive(f, spark.createDataFrame([], "content_sha256 string, archive_uri string"))
    archive.write_payloads(f, fresh, str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p")).collect()
    assert sorted(bytes(r.content) for r in got) == [b"x", b"y"] and {(r.family, str(r.day)) for r in got} == {("gov_il", "2024-02-03")}
    archive.write_report(fresh.groupBy("content_type").count(), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.json"))) == 1 and spark.read.json(str(tmp_path / "r")).count() == 2


def test_upsert_is_replay_safe_and_order_free(spark):
    cur = spark.createDataFrame([("a", "x", None, 1), ("b", "y", "k", 2)], "person_id string, name string, english_name string, source_tier int")
    rows = [("a", None, "e", 2, 1), ("a", "z", None, 3, 2), ("c", "n", None, 2, 3), ("c", None, "m", 1, 4)]
    schema = "person_id string, name string, english_name string, source_tier int, seq int"
    out = upsert.upsert(cur, spark.createDataFrame(rows, schema), "person_id", "seq", defaults=upsert.DEFAULTS["person"])
    want = [("a", "z", "e", 1), ("b", "y", "k", 2), ("c", "n", "m", 1)]
    assert sorted(tuple(r) for r in out.collect()) == want
    again = upsert.upsert(out, spark.createDataFrame(rows[::-1], schema).repartition(3), "person_id", "seq", defaults=upsert.DEFAULTS["person"])
    assert sorted(tuple(r) for r in again.collect()) == want
    run = upsert.run_adapter(spark.createDataFrame(rows, schema), lambda p: p, lambda r: r, cur, "person_id")
    assert run.table.count() == 3 and {r.stat: r.value for r in run.counts.collect()} == {"pages": 4, "parsed": 4, "upserted": 4} and run.archived is None
    pages = spark.createDataFrame(rows, schema).select("*", F.lit("c").cast("binary").alias("content"), F.lit("text/html").alias("content_type"), F.lit("gov_il").alias("family"), F.lit("u").alias("source_url"), F.current_timestamp().alias("captured_at"))
    run = upsert.run_adapter(pages, lambda p: p.select(*schema.replace(" string", "").replace(" int", "").split(", ")), lambda r: r, cur, "person_id", archived=spark.createDataFrame([], "content_sha256 string, archive_uri string"), write=lambda c, r: r.limit(1))
    assert run.table.count() == 1 and run.archived.count() == 1 and {r.stat: r.value for r in run.counts.collect()}["archived"] == 1


def test_edge_modes(spark):
    t = lambda y: dt.datetime(y, 1, 1)
    b = spark.createDataFrame([("p", "o", t(2000), t(2001), 1), ("p", "o", t(2005), None, 2), ("p", "o", None, t(2009), 3)], "person_id string, org_id string, valid_from timestamp, valid_to timestamp, seq int")
    none = b.drop("seq").limit(0)
    assert [(r.valid_from.year, r.valid_to.year) for r in upsert.merge_edges(none, b, "person_id", "org_id", "seq", "latest").collect()] == [(2005, 2001)]
    terms = upsert.merge_edges(none, b, "person_id", "org_id", "seq")
    assert sorted(r.valid_from.year for r in terms.collect()) == [2000, 2005]
    assert upsert.merge_edges(terms, b, "person_id", "org_id", "seq").exceptAll(terms).count() == 0
