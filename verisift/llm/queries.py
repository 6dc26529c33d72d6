"""The corpus operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontamination, fingerprints, hard_negatives, html_extract, mixing, ngram_join, pii, quality_outliers, sharding, token_counts, toxicity, warc
from .common import shared_folder, table, written
from .quality_sql import OP11

SHARDS = 24
VOCABULARY = "byte_bpe_50k.json"
KEY = "surrogates-1"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard(table(spark, sf_dir, "documents"), SHARDS, seed=1)
    text = F.coalesce(F.col("text"), F.lit(""))
    return d.select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontamination.mark_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html_extract.extract(table(spark, sf_dir, "pages"))
    return p.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = shared_folder(spark, "warc"), table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    placed = written(warc.scan_heads(spark, path), "placed")
    warc.write_index(placed, path, placed.count())
    # the record of every page, by its URL's key through the index
    found = written(warc.look_up(pages.select(warc.url_key(warc.stored_url(F.col("url"))).alias("key")), path).drop("key"), "found")
    got = warc.read_records(found, path)
    got = written(got.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest")), "read")
    # a revisit's payload is that of the response with its digest
    full = got.where("record_type = 'response'").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("p"))
    both = got.drop("payload_bytes", "payload_digest").join(full, "digest", "left").where(F.assert_true(F.coalesce(F.col("n"), F.lit(0)) == 1, "a digest without one response").isNull())
    return both.select("page_id", F.col("b").alias("payload_bytes"), F.col("p").alias("payload_digest"), "record_type", "refers_to")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    model = toxicity.train(d, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    s = toxicity.score(d, model)
    return s.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic_flag")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"), seed=6)
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return f.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY).select("doc_id", "text", "n_entities", "kinds")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    t = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return t.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers.quality(table(spark, sf_dir, "documents")).drop("distance")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchor=vec_id % 50 == 0, label=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv")
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"), lender=c - c % 5, lent=F.crc32(c.cast("string").cast("binary")) % 9)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_sharding, op2_decontamination, op3_html_extraction, op4_warc, op5_toxicity, op6_mixing, op7_fingerprints, op8_pii_surrogates, op9_token_counts, op10_ngram_join, op11_quality_rules, op12_hard_negatives, op13_conversation_trie, pipeline]
    return {f.__name__: f for f in ops}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(w[i:least(i + 12, len(w))], ' ') AS win, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""

OP4 = """
WITH p AS (SELECT page_id, row_number() OVER () AS r, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, first_value(page_id) OVER w AS top, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, r DESC))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 10 * (i // 8))::BIGINT, 10))::UBIGINT >> (5 * (7 - i % 8))) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM d
"""

OP6 = f"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split(translate(coalesce(text, ''), {BLANK}, '      '), ' '), lambda x: x <> ''))::BIGINT AS size,
  md5('6' || chr(1) || coalesce(doc_id::VARCHAR, '') || chr(1) || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, 3.0 * source_size / w AS ratio FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, coalesce(sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
  sum(source_size) OVER () AS total, sum(w) OVER () AS ws, row_number() OVER (ORDER BY ratio, source) AS i FROM c),
lv AS (SELECT (total - cb)::DOUBLE / (ws - wb) AS level, i FROM l WHERE cap >= (total - cb)::DOUBLE / (ws - wb) * w ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM c, lv),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN target - whole * source_size > 0 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(translate(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {BLANK}, '      '), ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN len(w)::VARCHAR ELSE '' END || ' ' || array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS v, b AS x FROM u UNION SELECT reach.v, u.b FROM reach JOIN u ON reach.x = u.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, (SELECT min(o.doc_id) FROM reach JOIN d o ON o.r = reach.x WHERE reach.v = d.r)) AS component_id
FROM d LEFT JOIN n ON n.r = d.r
"""


OP12 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS slot FROM s WHERE same QUALIFY slot <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ar, slot ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3
"""

# crc32 of a decimal, bit by bit: DuckDB has no such function
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

OP13 = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY i) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, {CRC32.format(x="c")} % 9 AS h FROM g),
r AS (SELECT h.c, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN g b ON b.c = h.c - h.c % 5),
m AS (SELECT c, d, turns[1:d] AS path, d = len(turns) AS ends, CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS bytes FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM n LEFT JOIN k USING (path, d)),
u AS (SELECT path[1:a] AS path, a AS d, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved FROM (SELECT path, n_children, saved, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (path, d) LEFT JOIN n p ON f.d > 0 AND p.d = f.d - 1 AND p.path = f.path[1:f.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op4_warc": OP4, "op6_mixing": OP6, "op10_ngram_join": OP10, "op11_quality_rules": OP11, "op12_hard_negatives": OP12, "op13_conversation_trie": OP13}
