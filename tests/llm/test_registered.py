"""The registered queries themselves: against their SQL, and the contract's columns and rows for the others."""

import base64
import hashlib
import os
import zlib

import duckdb
import pytest

from verisift.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted("|".join(shown(r[c]) for c in cols) for r in df.collect()) == sorted("|".join(shown(r[i]) for i in at) for r in want.fetchall())


def test_op1(spark, duck):
    got = {r.doc_id: r for r in queries.op1_sharding(spark, SF).collect()}
    docs = duck.sql("select doc_id, coalesce(text, '') from documents").fetchall()
    assert len(got) == len(docs) and all((got[i].size, got[i].text_crc32, got[i].law) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "rows") for i, t in docs)
    slots = {}
    for r in got.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op3(spark, duck):
    """The article of every page, cut out by hand: these pages have one article, and all else is beside it."""
    import html
    import re

    got = {r.page_id: r for r in queries.op3_html_extraction(spark, SF).collect()}
    pages = duck.sql("select page_id, url, html from pages").fetchall()
    assert len(got) == len(pages)
    for i, url, page in pages:
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\n", re.search(r"(?s)<article>(.*)</article>", page)[1]))
        lines = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in inner.split("\n")]
        want = "\n".join(x for x in lines if x)
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), url)


def test_op4_digests(spark, duck):
    for i, page in duck.sql("select page_id, html from pages").fetchall()[:3]:
        want = base64.b32encode(hashlib.sha1((page or "").encode()).digest()).decode()
        assert duck.sql(queries.OP4).filter(f"page_id = {i}").fetchall()[0][2] == want


def test_op5(spark, duck):
    got = queries.op5_toxicity(spark, SF).collect()
    assert len(got) == duck.sql("select count(*) from documents").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op7_op8_op9(spark, duck):
    docs = dict(duck.sql("select doc_id, coalesce(text, '') from documents").fetchall())
    prints = queries.op7_fingerprints(spark, SF).collect()
    order = sorted(docs, reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    by_text = {}
    for r in prints:
        t, n = docs[r.doc_id], docs[after[r.doc_id]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(prints) == len(docs)
    safe = queries.op8_pii_surrogates(spark, SF).collect()
    assert len(safe) == len(docs) and all((r.text or "") == docs[r.doc_id] for r in safe if r.n_entities == 0) and any(r.n_entities for r in safe)
    tokens = queries.op9_token_counts(spark, SF).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    assert len(tokens) == len(docs) and all((r.n_bytes, r.over_limit) == (len(docs[r.doc_id].encode()), r.n_tokens > 512) and r.n_tokens == len(library.encode(docs[r.doc_id], add_special_tokens=False).ids) for r in tokens)
