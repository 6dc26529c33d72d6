"""Registered queries: verdicts of all claim types, fallback answers, tie-breaks, name forms, tolerant casts, defaults, checks on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text
from .functions.keys import statement_key
from .operators import extract, rank, resolve, upsert, verdict
from .plans import demo, ingest, verify
from .plans.materialise import shared_folder
from .plans.schemas import SLOTS
from .queries import CHECKED, query, sentence_kb
from .queries_records import LADDER, ROWS_A_FILE, ladder_tables, stream_of_dealt
from .sources import readers
from .streaming import jobs

# ---------------------------------------------------------------- verdicts of every claim type

TYPES = ["vote_cast", "bill_sponsorship", "office_held", "committee_membership", "committee_attendance", "election_result", "government_decision", "statement_about_formal_action"]

VERDICTS = f"""
e AS (SELECT l_orderkey AS k, l_suppkey AS s, l_partkey AS b, l_linenumber % 3 <> 0 AS fact, l_linenumber % 3 <> 0 AND l_suppkey % 2 = 0 AS own, l_partkey % 4 + 1 AS tier, CASE WHEN l_partkey % 5 <> 0 THEN l_shipdate END AS occ, 'doc' || (l_suppkey % 3) AS doc,
  CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'short' ELSE repeat('x', 200) END AS txt, CASE l_partkey % 4 WHEN 0 THEN 'for' WHEN 1 THEN 'against' WHEN 2 THEN 'abstain' END AS vote, l_partkey % 3 = 0 AS present, (l_suppkey // 2) % 4 AS seats, l_partkey % 2 = 0 AS passed, 'g' || (l_suppkey // 2) % 3 AS decision
  FROM lineitem WHERE l_orderkey % 13 <> 0),
c AS (SELECT o_orderkey AS k, {TYPES}[1 + o_orderkey % 8] AS t, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS ts, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 60 DAY END AS te, CASE WHEN o_orderkey % 5 <> 0 THEN m.s END AS rs, CASE WHEN o_orderkey % 5 <> 0 THEN m.p END AS rb,
  CASE WHEN o_orderkey % 11 = 0 THEN 'insufficient_entity_resolution' WHEN o_orderkey % 17 = 0 THEN 'insufficient_time_scope' ELSE 'checkable' END AS chk, CASE WHEN o_orderkey % 5 <> 0 THEN ['for', 'against', 'abstain'][1 + o_orderkey % 3] END AS want, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey // 8) % 4 END AS want_seats,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey // 8) % 2 = 0 END AS want_passed, CASE WHEN o_orderkey % 3 <> 0 THEN 'g' || (o_orderkey // 8) % 3 END AS want_decision
  FROM orders JOIN (SELECT l_orderkey AS lk, min(struct_pack(s := l_suppkey, p := l_partkey)) AS m FROM lineitem GROUP BY 1) ON lk = o_orderkey),
x AS (SELECT e.*, t, want_seats, want_passed, want_decision, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 ELSE 0.1 END AS a1, CASE WHEN fact THEN CASE WHEN own THEN 1.0 ELSE 0.6 END WHEN txt = '' THEN 0.0 WHEN length(txt) < 160 THEN 0.75 ELSE 0.5 END AS a2,
  CASE WHEN fact THEN CASE WHEN occ IS NULL THEN 0.6 WHEN coalesce(occ < ts, false) OR coalesce(occ > te, false) THEN 0.2 ELSE 1.0 END ELSE CASE WHEN occ IS NULL THEN 0.5 WHEN coalesce(occ < ts, false) OR coalesce(occ > te, false) THEN 0.4 ELSE 0.8 END END AS a3,
  CASE WHEN rs IS NULL THEN 0.5 WHEN NOT fact THEN 0.6 WHEN (s = rs)::INT + (b = rb)::INT = 0 THEN 0.2 ELSE least(1.0, 0.5 + 0.25 * ((s = rs)::INT + (b = rb)::INT)) END AS a4 FROM e JOIN c USING (k)),
g AS (SELECT k, count(*) AS n, count(*) FILTER (own) AS nf, count(*) FILTER (NOT fact) AS nt, count(*) FILTER (own AND tier = 1) AS n1, count(*) FILTER (own AND present) AS np, list_sort(list(DISTINCT vote) FILTER (own AND vote IS NOT NULL)) AS vals, count(*) FILTER (own AND vote IS NULL) > 0 AS blank,
  count(*) FILTER (own AND (want_seats IS NULL OR seats = want_seats) AND (want_passed IS NULL OR passed = want_passed)) AS ne, count(*) FILTER (own AND (want_decision IS NULL OR decision = want_decision)) AS nd,
  round(0.30 * max(a1) + 0.25 * max(a2) + 0.20 * max(a3) + 0.15 * max(a4) + 0.10 * CASE WHEN count(DISTINCT doc) <= 1 THEN 0.3 WHEN count(DISTINCT doc) = 2 THEN 0.7 ELSE 1.0 END, 4)::DOUBLE AS o FROM x GROUP BY k),
j AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(nf, 0) AS nf, coalesce(nt, 0) AS nt, coalesce(n1, 0) AS n1, coalesce(np, 0) AS np, coalesce(vals, []) AS vals, coalesce(blank, false) AS blank, coalesce(ne, 0) AS ne, coalesce(nd, 0) AS nd, CASE WHEN chk = 'checkable' THEN coalesce(o, 0) ELSE 0 END AS o FROM c LEFT JOIN g USING (k)),
v AS (SELECT *, CASE WHEN chk <> 'checkable' THEN 'non_checkable' WHEN n = 0 OR o < 0.45 THEN 'insufficient_evidence'
  WHEN t = 'vote_cast' THEN CASE WHEN nf = 0 THEN 'insufficient_evidence' WHEN want IS NULL THEN 'supported' WHEN NOT list_contains(vals, want) THEN 'contradicted' WHEN len(vals) = 1 AND NOT blank THEN 'supported' ELSE 'mixed' END
  WHEN t = 'election_result' THEN CASE WHEN nf = 0 THEN 'insufficient_evidence' WHEN ne > 0 THEN 'supported' ELSE 'contradicted' END
  WHEN t = 'government_decision' THEN CASE WHEN nf = 0 THEN 'insufficient_evidence' WHEN nd > 0 THEN 'supported' ELSE 'contradicted' END
  WHEN t = 'committee_attendance' THEN CASE WHEN nf = 0 THEN 'insufficient_evidence' WHEN np > 0 THEN 'supported' ELSE 'contradicted' END
  WHEN t = 'statement_about_formal_action' THEN CASE WHEN nt >= 2 THEN 'supported' WHEN nt = 1 THEN 'mixed' ELSE 'insufficient_evidence' END
  ELSE CASE WHEN nf > 0 OR nt > 0 THEN 'supported' ELSE 'insufficient_evidence' END END AS status FROM j)
"""


@query(
    f"""WITH {VERDICTS} SELECT k::VARCHAR AS claim_id, t AS claim_type, status, o::DOUBLE AS overall, n::BIGINT AS n_evidence, nf::BIGINT AS n_facts, nt::BIGINT AS n_text,
    CASE WHEN chk <> 'checkable' THEN chk = 'insufficient_entity_resolution' WHEN n = 0 OR o < 0.45 THEN true ELSE o < 0.62 OR status = 'mixed' OR (status = 'contradicted' AND nf > 0 AND n1 = 0) END AS needs_human_review,
    CASE WHEN status IN ('non_checkable', 'insufficient_evidence') THEN 'abstain' WHEN status = 'mixed' THEN 'mixed' WHEN status = 'supported' THEN 'support' ELSE 'contradict' END AS reason_kind,
    CASE WHEN chk <> 'checkable' THEN 'checkability:' || chk WHEN n = 0 THEN 'no_evidence' WHEN o < 0.45 THEN 'low_confidence' WHEN status = 'insufficient_evidence' THEN CASE t WHEN 'vote_cast' THEN 'no_graph_vote_record' WHEN 'election_result' THEN 'no_election_graph_hit' WHEN 'government_decision' THEN 'no_gov_decision_graph_hit' WHEN 'committee_attendance' THEN 'no_attendance_graph_hit' WHEN 'statement_about_formal_action' THEN 'no_corroboration' ELSE 'no_graph_or_lex_support' END END AS abstained_for FROM v"""
)
def verdict_types(t: demo.Tables) -> DataFrame:
    """Verdict, confidence, review flag and first reason of claims of all eight types: lines are facts and texts of every tier, date, value and kind."""
    supp, part, half = demo.s("l_suppkey"), demo.s("l_partkey"), F.floor(F.col("l_suppkey") / 2)
    fact, at = F.col("l_linenumber") % 3 != 0, F.when(F.col("l_partkey") % 5 != 0, F.col("l_shipdate"))
    kind = demo.pick(F.col("l_orderkey") % 8, *TYPES)
    e = t.lineitem.where("l_orderkey % 13 <> 0").select(
        demo.s("l_orderkey").alias("claim_id"), F.when(fact, "fact").otherwise("text").alias("kind"), F.when(F.col("l_suppkey") % 2 == 0, kind).otherwise("other").alias("evidence_type"),
        F.create_map(F.lit("speaker_person_id"), supp, F.lit("bill_id"), part, F.lit("government_decision_id"), F.concat(F.lit("g"), (half % 3).cast("string"))).alias("node_ids"), (F.col("l_partkey") % 4 + 1).alias("source_tier"), at.alias("occurred_at"), at.alias("captured_at"),
        F.array(F.concat(F.lit("doc"), (F.col("l_suppkey") % 3).cast("string"))).alias("source_document_ids"), demo.pick(F.col("l_suppkey") % 3, "", "short", "x" * 200).alias("text"), demo.s("l_linenumber").alias("span_id"),
        F.when(F.col("l_partkey") % 4 != 3, demo.pick(F.col("l_partkey") % 4, "for", "against", "abstain")).alias("vote_value"), F.when(F.col("l_partkey") % 3 == 0, "present").otherwise("absent").alias("presence"), (half % 4).cast("int").alias("seats_won"), (F.col("l_partkey") % 2 == 0).alias("passed_threshold"),
    )
    k = F.col("o_orderkey")
    eighth = F.floor(k / 8)
    claims = t.order_pairs().select(
        demo.s("o_orderkey").alias("claim_id"), demo.pick(k % 8, *TYPES).alias("claim_type"), F.when(k % 3 != 0, F.col("o_orderdate")).alias("time_start"), F.when(k % 4 != 0, F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("time_end"),
        F.when(k % 5 != 0, demo.ids("l_suppkey", "l_partkey")).alias("raw_ids"), F.when(k % 11 == 0, "insufficient_entity_resolution").when(k % 17 == 0, "insufficient_time_scope").otherwise("checkable").alias("checkability"),
        F.when(k % 5 != 0, demo.pick(k % 3, "for", "against", "abstain")).alias("expected_vote_value"), F.when(k % 5 != 0, (eighth % 4).cast("int")).alias("expected_seats"), F.when(k % 7 != 0, eighth % 2 == 0).alias("expect_passed_threshold"),
        F.when(k % 3 != 0, F.concat(F.lit("g"), (eighth % 3).cast("string"))).alias("government_decision_id"),
    )
    claims = claims.withColumn("resolved_ids", F.when(F.col("raw_ids").isNotNull(), F.create_map(F.lit("speaker_person_id"), F.col("raw_ids.l_suppkey").cast("string"), F.lit("bill_id"), F.col("raw_ids.l_partkey").cast("string")))).drop("raw_ids")
    v = verdict.decide(claims, rank.score(e, claims))
    first = F.get("reasons", F.lit(0))
    return v.select(
        "claim_id", "claim_type", "status", F.col("confidence.overall").alias("overall"), "n_evidence", "n_facts", "n_text", "needs_human_review", first.kind.alias("reason_kind"), F.when(first.kind == "abstain", first.reason).alias("abstained_for"),
    )


# ---------------------------------------------------------------- answers for statements without a valid claim


def noted(t: demo.Tables) -> tuple[DataFrame, DataFrame]:
    """Every third order is a sentence that a rule reads, the others are notes; for most notes answers are at hand, some of them not valid."""
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("Dan "), demo.letters(demo.s("o_custkey")), F.lit(" sponsored the plan "), demo.letters(demo.s("o_orderkey")), F.lit(" bill"))).otherwise(F.concat(F.lit(" note "), demo.s("o_orderkey"), F.lit(" of "), demo.s("o_custkey"), F.lit(" ")))
    statements = t.orders.select(demo.s("o_orderkey").alias("statement_id"), said.alias("text"), F.lit("en").alias("language"))
    none = F.lit(None).cast("string")
    given = {s: none for s in [*SLOTS, "government_number"]} | {"speaker_person_id": F.concat(F.lit("p"), demo.s("o_custkey")), "bill_id": F.when(k % 5 != 0, F.concat(F.lit("b"), demo.s("o_orderkey"))), "committee_id": F.when(k % 11 == 0, "c")}
    answers = t.orders.where((k % 7 != 0)).select(
        F.lit("en").alias("language"), statement_key(F.lit("en"), F.trim(said)).alias("text_key"), F.explode(F.array(F.lit(1), F.lit(2))).alias("answer_seq"), F.lit("bill_sponsorship").alias("claim_type"), *[c.alias(s) for s, c in given.items()],
        F.when(k % 2 == 0, F.concat(F.lit("said "), demo.s("o_orderkey"))).otherwise("").alias("normalized_text"), F.when(k % 13 == 0, "2001").alias("time_phrase"),
    )
    return statements, answers


NOTED = """o AS (SELECT o_orderkey AS k, o_custkey AS c, translate(o_custkey::VARCHAR, '0123456789', 'abcdefghij') AS cl, translate(o_orderkey::VARCHAR, '0123456789', 'abcdefghij') AS kl FROM orders),
a AS (SELECT *, unnest([1, 2]) AS seq, k % 5 <> 0 AND k % 11 <> 0 AS ok FROM o WHERE k % 3 <> 0 AND k % 7 <> 0)"""


@query(
    f"""WITH {NOTED} SELECT k::VARCHAR AS statement_id, 'rules' AS method, 'Dan ' || cl AS speaker_person_id, 'plan ' || kl AS bill_id, 'Dan ' || cl || ' sponsored the plan ' || kl || ' bill' AS normalized_text, 'unknown' AS granularity FROM o WHERE k % 3 = 0
    UNION ALL SELECT k::VARCHAR, 'llm', 'p' || c, 'b' || k, CASE WHEN k % 2 = 0 THEN 'said ' || k ELSE 'note ' || k || ' of ' || c END, CASE WHEN k % 13 = 0 THEN 'year' ELSE 'unknown' END FROM a WHERE ok"""
)
def fallback_answers(t: demo.Tables) -> DataFrame:
    """Cached answers make claims of statements in which no rule finds one, if they pass the slot check."""
    statements, answers = noted(t)
    claims, _ = extract.extract(statements, F.to_date(F.lit("2024-06-01")), answers)
    return claims.select("statement_id", "method", "speaker_person_id", "bill_id", "normalized_text", F.col("time_scope.granularity").alias("granularity"))


@query(
    f"""WITH {NOTED}, s AS (SELECT k, count(seq) AS seen, count(*) FILTER (ok) AS ok FROM o LEFT JOIN a USING (k) GROUP BY k) SELECT k::VARCHAR AS statement_id, (k % 3 = 0)::INT AS rule_matches, (CASE WHEN k % 3 = 0 THEN 1 ELSE ok END)::INT AS n_claims, seen > 0 AS fallback_used, (seen - ok)::INT AS n_errors FROM s"""
)
def fallback_summary(t: demo.Tables) -> DataFrame:
    """What each statement gave: matches of rules, valid claims, whether answers were used, and how many of them the slot check rejected."""
    statements, answers = noted(t)
    _, summary = extract.extract(statements, F.to_date(F.lit("2024-06-01")), answers)
    return summary.select("statement_id", F.col("rule_matches").cast("int").alias("rule_matches"), F.col("n_claims").cast("int").alias("n_claims"), "fallback_used", F.size("errors").alias("n_errors"))


@query(
    f"""WITH {LADDER}, g AS (SELECT k, n, way, list(e ORDER BY e) AS es FROM m LEFT JOIN hit USING (k) GROUP BY ALL)
    SELECT k::VARCHAR AS mention_id, CASE WHEN len(list_filter(es, lambda x: x IS NOT NULL)) = 0 THEN 'unresolved' WHEN len(es) = 1 THEN 'resolved' WHEN k % 2 = 0 THEN 'resolved' ELSE 'ambiguous' END AS status,
    CASE WHEN len(es) = 1 THEN es[1]::VARCHAR WHEN k % 2 = 0 THEN n::VARCHAR END AS entity_id FROM g"""
)
def tie_breaks(t: demo.Tables) -> DataFrame:
    """Ambiguous mentions with a pick: one among the candidates decides, any other changes nothing."""
    mentions, entities, aliases = ladder_tables(t)
    k = F.col("c_custkey")
    picks = t.customer.select(demo.s("c_custkey").alias("mention_id"), F.when(k % 2 == 0, demo.s("c_nationkey")).otherwise("nobody").alias("pick"))
    return resolve.decide(mentions, resolve.ladder(mentions, entities, aliases, fuzzy=False), picks).select("mention_id", "status", "entity_id")


# ---------------------------------------------------------------- text columns

DIGITS_HE = "אבחדהשצטיץ"


@query(
    f"""WITH r AS (SELECT c_custkey AS k, '  דָּ' || chr(9) || 'ן  ' || translate(c_custkey::VARCHAR, '0123456789', '{DIGITS_HE}') || ' ם' || chr(1468) || ' Ab ' AS raw FROM customer),
    n AS (SELECT k, trim(regexp_replace(regexp_replace(raw, '[\\x{{0591}}-\\x{{05C7}}]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM r)
    SELECT k, name, lower(replace(replace(replace(replace(translate(name, '{text.SINGLE[0]}', '{text.SINGLE[1]}'), 'ח', 'ch'), 'צ', 'tz'), 'ץ', 'tz'), 'ש', 'sh')) AS latin, sha256('he::' || name)[1:16] AS statement_key FROM n"""
)
def name_forms(t: demo.Tables) -> DataFrame:
    """Hebrew names with points and odd white space: normal form, Latin letters, key."""
    raw = F.concat(F.lit("  דָּ\tן  "), F.translate(demo.s("c_custkey"), "0123456789", DIGITS_HE), F.lit(" םּ Ab "))
    name = text.normalize_hebrew(F.col("raw"))
    return t.customer.select(F.col("c_custkey").alias("k"), raw.alias("raw")).select("k", name.alias("name"), text.transliterate_hebrew(F.col("raw")).alias("latin"), statement_key(F.lit("he"), name).alias("statement_key"))


def odd_slots(k: Column) -> dict[str, Column]:
    user, at = demo.s("user_id"), F.col("ts")
    return {
        "slot": F.when(k % 6 == 0, F.concat(F.lit(" "), user, F.lit(" "))).otherwise(demo.pick(k % 6, "", "x12", "TRUE", " no ", "1", "")),
        "share": F.when(k % 4 == 0, F.concat((F.col("user_id") % 100).cast("string"), F.lit(".25%"))).when(k % 4 == 1, F.concat((F.col("user_id") % 100).cast("string"), F.lit("%%"))).when(k % 4 == 2, "n/a"),
        "stamp": F.when(k % 5 == 0, F.date_format(at, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(k % 5 == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(k % 5 == 3, "soon"),
    }


@query(
    """WITH s AS (SELECT event_id AS k, CASE event_id % 6 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN 'x12' WHEN 2 THEN 'TRUE' WHEN 3 THEN ' no ' WHEN 4 THEN '1' ELSE '' END AS slot, CASE event_id % 4 WHEN 0 THEN (user_id % 100) || '.25' WHEN 1 THEN (user_id % 100) || '' WHEN 2 THEN 'n/a' END AS share, event_id % 5 AS w, date_trunc('second', ts) AS ts FROM events)
    SELECT k, try_cast(trim(slot) AS INT) AS as_int, CASE WHEN lower(trim(slot)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(slot)) IN ('false', '0', 'no') THEN false END AS as_bool, coalesce(round(try_cast(share AS DOUBLE) / 100, 6), 0)::DOUBLE AS share,
    CASE WHEN w = 0 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN w < 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp FROM s"""
)
def slot_casts(t: demo.Tables) -> DataFrame:
    """Slots as whole numbers and truth values, shares with percent signs, dates with T, with a space, alone, and unreadable ones."""
    d = t.events.select(F.col("event_id").alias("k"), *[c.alias(n) for n, c in odd_slots(F.col("event_id")).items()])
    return d.select("k", text.parse_int(F.col("slot")).alias("as_int"), text.parse_bool(F.col("slot")).alias("as_bool"), text.vote_share(F.col("share")).alias("share"), F.date_format(text.safe_timestamp(F.col("stamp")), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query(
    """WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' WHEN 2 THEN 'year' WHEN 3 THEN 'term' WHEN 4 THEN 'year' ELSE 'unknown' END AS granularity FROM orders) SELECT k, granularity FROM p"""
)
def offline_granularities(t: demo.Tables) -> DataFrame:
    """How exact a time phrase is without any table: no phrase is unknown."""
    k = F.col("o_orderkey")
    phrase = F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, "  ").when(k % 6 == 2, F.concat(F.lit("in "), F.year("o_orderdate").cast("string"))).when(k % 6 == 3, "the 18th Knesset").when(k % 6 == 4, "last year").otherwise("some day")
    return t.orders.select(k.alias("k"), extract.offline_granularity(phrase, F.to_date("o_orderdate")).alias("granularity"))


@query(
    """WITH p AS (SELECT doc_id, encode(array_to_string(string_split(text, chr(10))[1:2], chr(10)))[1:60] AS b FROM documents) SELECT doc_id, octet_length(b)::INT AS n_bytes, md5(b) AS md5 FROM p"""
)
def payload_samples(t: demo.Tables) -> DataFrame:
    """The first two lines of every payload, and of those the first sixty bytes."""
    cut = readers.truncate_payload(F.encode("text", "UTF-8"), max_lines=2, max_bytes=60)
    return t.documents.select("doc_id", F.octet_length(cut).alias("n_bytes"), F.md5(cut).alias("md5"))


# ---------------------------------------------------------------- upserts with defaults


@query(
    """WITH o AS (SELECT p_partkey AS id, p_name AS title, NULL::VARCHAR AS he, 2 AS tier FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS title, CASE WHEN p_partkey % 7 = 0 THEN p_type END AS he, (1 + p_partkey % 3)::INT AS tier FROM part WHERE p_partkey % 2 = 0),
    u AS (SELECT id, coalesce(n.title, o.title) AS title, coalesce(n.he, o.he) AS he, least(o.tier, n.tier) AS tier, n.tier IS NOT NULL AS new FROM o FULL JOIN n USING (id)) SELECT id AS bill_id, title, CASE WHEN new THEN coalesce(he, title, '') ELSE he END AS hebrew_name, tier::INT AS source_tier FROM u"""
)
def upsert_defaults(t: demo.Tables) -> DataFrame:
    """Bills upserted by last non-null value and best tier; an empty Hebrew name of a bill that the batch brings takes the title, or nothing."""
    k = F.col("p_partkey")
    old = t.part.where(k % 3 != 0).select(k.alias("bill_id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("hebrew_name"), F.lit(2).alias("source_tier"))
    new = t.part.where(k % 2 == 0).select(k.alias("bill_id"), F.when(k % 5 != 0, F.col("p_brand")).alias("title"), F.when(k % 7 == 0, F.col("p_type")).alias("hebrew_name"), (1 + k % 3).cast("int").alias("source_tier"), k.alias("seq"))
    return upsert.upsert(old, new, "bill_id", "seq", defaults=upsert.DEFAULTS["bill"])


# ---------------------------------------------------------------- checks on streams, run to their end


@query(f"WITH {CHECKED} SELECT statement_id, claim_type, checkability, status, overall FROM bundle")
def stream_statement_check(t: demo.Tables) -> DataFrame:
    """Sentences as a stream, each micro-batch checked against the same tables: all batches together are the check of the whole."""
    kb, out = sentence_kb(t), shared_folder(t.spark, "checked")
    check = lambda batch: verify.verify(batch, kb, F.to_date(F.lit("2024-06-01")))
    jobs.check_stream(stream_of_dealt(t.sentences(ROWS_A_FILE).select("statement_id", "text", "language"), "in", 2), check, out, shared_folder(t.spark, "mark")).awaitTermination()
    return jobs.appended(t.spark, out).select("statement_id", "claim_type", "checkability", "status", F.col("confidence.overall").alias("overall"))


@query(
    """WITH now AS (SELECT date_trunc('second', max(ts)) AS now FROM events), runs AS (SELECT event_type AS f, user_id AS a, date_trunc('second', max(ts)) AS last FROM events WHERE event_type <> 'error' GROUP BY ALL), mf AS (SELECT DISTINCT event_type AS f, user_id AS a FROM events)
    SELECT mf.f AS family, mf.a::VARCHAR AS adapter, date_diff('second', last, now) AS age_s, coalesce(date_diff('second', last, now) > 2 * CASE WHEN mf.a % 2 = 0 THEN 3600 ELSE 86400 END, false) AS stale FROM mf LEFT JOIN runs USING (f, a), now"""
)
def stream_freshness(t: demo.Tables) -> DataFrame:
    """Events as ticks: the freshness report as of the last tick."""
    e = t.events.withColumn("ts", F.date_trunc("second", F.col("ts")))
    manifests = e.select(F.col("event_type").alias("family"), demo.s("user_id").alias("adapter"), F.when(F.col("user_id") % 2 == 0, "7 * * * *").otherwise("7 3 * * *").alias("cadence_cron")).distinct()
    runs = e.select(F.col("event_type").alias("source_family"), demo.s("user_id").alias("adapter"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), F.col("ts").alias("finished_at"))
    path, out = shared_folder(t.spark, "ticks"), shared_folder(t.spark, "fresh")
    e.select(F.col("ts").alias("timestamp")).coalesce(1).write.parquet(path)
    jobs.freshness_stream(t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path), manifests, lambda: runs, out, shared_folder(t.spark, "mark")).awaitTermination()
    return jobs.current(t.spark, out).select("family", "adapter", "age_s", "stale")


# ---------------------------------------------------------------- full ingest


def raw_sources(t: demo.Tables) -> dict[str, DataFrame]:
    """Raw rows of ten sources: lines are votes and initiators, orders positions, memberships and sessions."""
    o, k, c, date = t.orders, F.col("o_orderkey"), F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    seq, line_seq = k.alias("seq"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("seq")
    p, s, gov = F.col("p_partkey"), F.col("s_suppkey"), c % 40
    ids_ = F.when(F.col("o_orderstatus") == "P", "[broken").otherwise(F.concat(F.lit('["'), demo.s("o_custkey"), F.lit('", "'), (c + 1).cast("string"), F.lit('", ""]')))
    none = F.lit(None).cast("string")
    return {
        "people": t.supplier.select(F.when(s % 7 != 0, s).alias("PersonID"), F.col("s_name").alias("FirstName"), none.alias("LastName"), F.lit(True).alias("IsCurrent"), s.alias("seq")),
        "bills": t.part.select(p.alias("BillID"), F.col("p_name").alias("Name"), F.col("p_size").alias("KnessetNum"), (p % 3).alias("StatusID"), p.alias("seq")),
        "committees": t.nation.select(F.col("n_nationkey").alias("CommitteeID"), F.col("n_name").alias("Name"), F.col("n_nationkey").alias("seq")),
        "initiators": t.lineitem.select(F.lit(1).alias("BillInitiatorID"), F.col("l_partkey").alias("BillID"), F.col("l_suppkey").alias("PersonID"), (F.col("l_returnflag") == "A").alias("IsInitiator"), F.col("l_linenumber").alias("Ordinal"), line_seq),
        "votes": t.lineitem.select(demo.s("l_orderkey").alias("vote_id"), F.lpad(demo.s("l_suppkey"), 9, "0").alias("kmmbr_id"), none.alias("kmmbr_name"), (F.col("l_linenumber") % 5).cast("string").alias("vote_result"), line_seq),
        "positions": o.select(
            k.alias("PersonToPositionID"), c.alias("PersonID"), (k % 70).cast("int").alias("PositionID"), (c % 50).alias("FactionID"), none.alias("FactionName"), gov.alias("GovMinistryID"), F.when(gov != 0, F.concat(F.lit("ministry "), gov.cast("string"))).alias("GovMinistryName"),
            F.col("o_orderpriority").alias("DutyDesc"), F.when(F.col("o_orderstatus") != "P", date).alias("StartDate"), F.when(F.col("o_orderstatus") == "F", date).alias("FinishDate"), seq,
        ),
        "memberships": o.select(demo.s("o_custkey").alias("mk_individual_id"), (k % 40).cast("string").alias("committee_id"), none.alias("committee_name"), F.when(k % 13 != 0, date).alias("start_date"), none.alias("finish_date"), F.lit("20").alias("knesset"), seq),
        "attendance": o.select(k.alias("CommitteeSessionID"), (k % 5 + 1).alias("CommitteeID"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("StartDate"), ids_.alias("attended_mk_individual_ids"), seq),
        "elections": t.election_rows().withColumn("seq", F.lit(1)),
        "decisions": t.customer.select(demo.s("c_custkey").alias("id"), demo.s("c_nationkey").alias("procedure_number_str"), F.lit("הממשלה ה-37").alias("government"), F.lit("2024-01-02").alias("publish_date"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("text"), none.alias("office"), none.alias("url_id"), F.col("c_custkey").alias("seq")),
    }


@query(
    """WITH pos AS (SELECT o_custkey AS p, o_custkey % 50 AS f, (o_orderkey % 70) || ':' || CASE WHEN o_custkey % 40 = 0 THEN '-' ELSE (o_custkey % 40)::VARCHAR END AS o, o_orderkey AS t, o_orderdate::DATE AS d, o_orderstatus = 'F' AS ended FROM orders WHERE o_orderstatus <> 'P' AND o_custkey <> 0 AND o_orderkey <> 0),
    mem AS (SELECT DISTINCT o_custkey * 10 AS p, o_orderkey % 40 AS c, o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 40 <> 0 AND o_orderkey % 13 <> 0 AND o_custkey % 6 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)),
    ini AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS b FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey <> 0 AND l_partkey <> 0), vot AS (SELECT l_orderkey AS e, l_suppkey AS p, l_linenumber % 5 AS r, l_partkey * 100 + l_linenumber AS seq FROM lineitem WHERE l_orderkey <> 0),
    ses AS (SELECT o_orderkey AS s, o_orderkey % 5 + 1 AS c FROM orders WHERE o_orderkey <> 0), att AS (SELECT DISTINCT s, m * 10 AS p FROM (SELECT o_orderkey AS s, unnest([o_custkey, o_custkey + 1]) AS m FROM orders WHERE o_orderkey <> 0 AND o_orderstatus <> 'P') JOIN customer ON c_custkey = m AND m % 6 <> 0),
    ele AS (SELECT DISTINCT n_regionkey || ':L' || regexp_extract(n_name, '(\\d+)$', 1) AS e, CASE WHEN n_nationkey % 2 = 0 THEN 'f' || n_nationkey ELSE 'l' || n_regionkey || ':' || regexp_extract(n_name, '(\\d+)$', 1) END AS f FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey),
    person AS (SELECT s_suppkey AS p, 1 AS f FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT p, 0 FROM pos UNION ALL SELECT p, 0 FROM mem UNION ALL SELECT p, 0 FROM ini UNION ALL SELECT p, 0 FROM vot UNION ALL SELECT p, 0 FROM att),
    party AS (SELECT 'f' || f AS f, 1 AS g FROM pos WHERE f <> 0 UNION ALL SELECT f, 0 FROM ele), com AS (SELECT n_nationkey AS c, 1 AS f FROM nation WHERE n_nationkey <> 0 UNION ALL SELECT c, 0 FROM mem UNION ALL SELECT c, 0 FROM ses), bil AS (SELECT p_partkey AS b, 1 AS f FROM part WHERE p_partkey <> 0 UNION ALL SELECT b, 0 FROM ini),
    cv AS (SELECT e, p, arg_max(r, seq) AS r FROM vot WHERE r IN (1, 2, 3) GROUP BY e, p)
    SELECT 'person' AS label, count(DISTINCT p) AS n, count(DISTINCT p) FILTER (f = 1) AS filled FROM person UNION ALL SELECT 'party', count(DISTINCT f), count(DISTINCT f) FILTER (g = 1) FROM party UNION ALL SELECT 'office', count(DISTINCT o), count(DISTINCT o) FROM pos
    UNION ALL SELECT 'committee', count(DISTINCT c), count(DISTINCT c) FILTER (f = 1) FROM com UNION ALL SELECT 'bill', count(DISTINCT b), count(DISTINCT b) FILTER (f = 1) FROM bil UNION ALL SELECT 'vote_event', count(DISTINCT e), 0 FROM vot UNION ALL SELECT 'attendance_event', count(DISTINCT s), count(DISTINCT s) FROM ses
    UNION ALL SELECT 'position_term', count(DISTINCT t), count(DISTINCT t) FILTER (ended) FROM pos UNION ALL SELECT 'election_result', count(DISTINCT e), count(DISTINCT e) FROM ele UNION ALL SELECT 'government_decision', count(*), count(*) FROM customer
    UNION ALL SELECT 'cast_vote', count(*), count(*) FILTER (r = 1) FROM cv UNION ALL SELECT 'attended', count(*), count(*) FROM att UNION ALL SELECT 'sponsored', count(*), count(*) FROM ini
    UNION ALL SELECT 'member_of', count(DISTINCT (p, f, d)), count(DISTINCT (p, f, d)) FILTER (ended) FROM pos WHERE f <> 0 UNION ALL SELECT 'held_office', count(DISTINCT (p, o, d)), count(DISTINCT (p, o, d)) FILTER (ended) FROM pos UNION ALL SELECT 'member_of_committee', count(*), 0 FROM mem
    UNION ALL SELECT 'has_position_term', count(DISTINCT (p, t)), count(DISTINCT (p, t)) FROM pos UNION ALL SELECT 'about_office', count(DISTINCT (t, o)), count(DISTINCT (t, o)) FROM pos UNION ALL SELECT 'for_party', count(*), count(*) FROM ele"""
)
def full_ingest(t: demo.Tables) -> DataFrame:
    """All ten sources into ten entity and nine edge tables: rows of each table, and how many are filled (stubs and open ends are not)."""
    members = readers.load_lookup(t.customer.select(demo.s("c_custkey").alias("mk_individual_id"), F.when(F.col("c_custkey") % 6 != 0, (F.col("c_custkey") * 10).cast("string")).alias("PersonID"), F.lit(1).alias("seq")), "mk_individual_id", "PersonID", F.col("seq"))
    g = ingest.ingest(raw_sources(t), shared_folder(t.spark, "ingest"), members=members, lists=t.list_mapping())
    filled = {
        "person": "canonical_name", "party": "canonical_name", "office": "canonical_name", "committee": "canonical_name", "bill": "title", "vote_event": "occurred_at", "attendance_event": "occurred_at", "position_term": "valid_to", "election_result": "list_name", "government_decision": "title",
        "attended": "presence", "sponsored": "ordinal", "member_of": "valid_to", "held_office": "valid_to", "member_of_committee": "valid_to", "has_position_term": "person_id", "about_office": "office_id", "for_party": "list_party_id",
    }
    out = None
    for label, df in {**g.nodes, **g.edges}.items():
        row = df.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("value") == "for") if label == "cast_vote" else F.count(filled[label])).alias("filled")).select(F.lit(label).alias("label"), "n", "filled")
        out = row if out is None else out.unionByName(row)
    return out
