"""The registered queries outside the corpus operators, each with DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, text, timescope
from .operators import adapters, attribution, extract, lexical, metrics, quality, rank, resolve, retrieve, review, upsert, verdict
from .plans import demo, verify
from .plans.materialise import kept
from .sources import archive, readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[demo.Tables], DataFrame]], Callable]:
    def add(f: Callable[[demo.Tables], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(demo.Tables(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import queries_checks, queries_records  # noqa: F401  register more

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_checks, queries_records  # noqa: F401

    return dict(_SQL)


def day(c: str):
    return F.col(c).cast("date").cast("string")


# ---------------------------------------------------------------- votes: the flagship, ranking, confidence, verdicts

VOTES = """
votes AS (SELECT l_suppkey AS p, l_partkey AS b, l_orderkey || '-' || l_suppkey || '-' || l_partkey || '-' || l_linenumber || '-' || strftime(l_shipdate, '%Y%m%d') AS ev, CASE l_returnflag WHEN 'A' THEN 'for' WHEN 'R' THEN 'against' ELSE 'abstain' END AS value, l_shipdate AS tm, 'doc' || l_linenumber AS doc FROM lineitem),
pairs AS (SELECT l_orderkey AS k, min(struct_pack(s := l_suppkey, p := l_partkey)) AS m FROM lineitem GROUP BY 1),
claims AS (SELECT o_orderkey AS k, m.s AS p, m.p AS b, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CASE o_orderkey % 3 WHEN 0 THEN 'for' WHEN 1 THEN 'against' ELSE 'abstain' END END AS want,
  CASE WHEN o_orderkey % 4 <> 0 THEN make_date(year(o_orderdate), 1, 1)::TIMESTAMP END AS ts, CASE WHEN o_orderkey % 4 <> 0 THEN make_date(year(o_orderdate) + 3, 1, 1)::TIMESTAMP END AS te,
  CASE WHEN o_orderkey % 11 = 0 THEN 'insufficient_time_scope' WHEN o_orderkey % 13 = 0 THEN 'insufficient_entity_resolution' ELSE 'checkable' END AS chk
  FROM orders JOIN pairs ON k = o_orderkey),
facts AS (SELECT c.*, v.ev, v.value, v.tm, v.doc, row_number() OVER (PARTITION BY c.k ORDER BY v.tm DESC, v.ev) AS rn FROM claims c JOIN votes v USING (p, b)
  WHERE (ts IS NULL OR tm >= ts) AND (te IS NULL OR tm <= te)),
ev AS (SELECT f.*, count(DISTINCT doc) OVER (PARTITION BY k) AS docs FROM facts f WHERE rn <= 10),
sc AS (SELECT *, CASE WHEN docs <= 1 THEN 0.3 WHEN docs = 2 THEN 0.7 ELSE 1.0 END AS cs,
  round(0.30 * 1.0 + 0.25 * 1.0 + 0.20 * 1.0 + 0.15 * 1.0 + 0.10 * (CASE WHEN docs <= 1 THEN 0.3 WHEN docs = 2 THEN 0.7 ELSE 1.0 END), 4)::DOUBLE AS overall FROM ev),
agg AS (SELECT k, count(*) AS n, max(overall) AS overall, max(cs) AS cs, list_sort(list(DISTINCT value)) AS vals FROM sc GROUP BY k),
ver AS (SELECT c.k, c.want, c.chk, coalesce(a.n, 0) AS n, a.vals, a.overall, a.cs,
  CASE WHEN chk <> 'checkable' THEN 'non_checkable' WHEN a.n IS NULL THEN 'insufficient_evidence' WHEN a.overall < 0.45 THEN 'insufficient_evidence' WHEN want IS NULL THEN 'supported'
    WHEN len(vals) = 1 AND list_contains(vals, want) THEN 'supported' WHEN list_contains(vals, want) THEN 'mixed' ELSE 'contradicted' END AS status
  FROM claims c LEFT JOIN agg a USING (k))
"""
REVIEW = "CASE WHEN chk <> 'checkable' THEN chk = 'insufficient_entity_resolution' WHEN n = 0 THEN true ELSE overall < 0.62 OR status = 'mixed' END"


def ranked_votes(t: demo.Tables) -> tuple[DataFrame, DataFrame]:
    claims = kept(t.vote_claims(), "claims")  # retrieval, ranking and verdicts read them
    return claims, rank.score(retrieve.vote_cast(claims, t.vote_kb()), claims)


@query(f"WITH {VOTES} SELECT k::VARCHAR AS claim_id, status, CASE WHEN chk = 'checkable' AND n > 0 THEN overall ELSE 0.0 END::DOUBLE AS overall, {REVIEW} AS needs_human_review FROM ver")
def vote_check(t: demo.Tables) -> DataFrame:
    claims, ranked = ranked_votes(t)
    v = verdict.decide(claims, ranked)
    return v.select("claim_id", "status", F.col("confidence.overall").alias("overall"), "needs_human_review")


@query(f"WITH {VOTES} SELECT status, count(*) AS n FROM ver GROUP BY status")
def vote_status_counts(t: demo.Tables) -> DataFrame:
    claims, ranked = ranked_votes(t)
    return verdict.decide(claims, ranked).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VOTES} SELECT k::VARCHAR AS claim_id, ev AS vote_event_id, cs::DOUBLE AS cross_source, overall, row_number() OVER (PARTITION BY k ORDER BY overall DESC, list_aggregate(list_sort([p::VARCHAR, b::VARCHAR, ev]), 'string_agg', ':'), tm DESC) AS rank FROM sc")
def evidence_rank(t: demo.Tables) -> DataFrame:
    _, r = ranked_votes(t)
    return r.select("claim_id", F.element_at("node_ids", "vote_event_id").alias("vote_event_id"), F.col("cross_source_consistency").alias("cross_source"), "overall", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VOTES} SELECT k::VARCHAR AS claim_id, 1.0::DOUBLE AS source_authority, 1.0::DOUBLE AS temporal_alignment, 1.0::DOUBLE AS entity_resolution, max(cs)::DOUBLE AS cross_source_consistency, max(overall) AS overall FROM sc GROUP BY k")
def confidence(t: demo.Tables) -> DataFrame:
    _, r = ranked_votes(t)
    return rank.confidence(r).select("claim_id", F.col("source_tier_score").alias("source_authority"), "temporal_alignment", "entity_resolution", "cross_source_consistency", "overall")


@query(
    f"""WITH {VOTES} SELECT k::VARCHAR AS claim_id, CASE WHEN chk <> 'checkable' OR n = 0 THEN 'abstain' WHEN status = 'supported' THEN 'support' WHEN status = 'mixed' THEN 'mixed' ELSE 'contradict' END AS kind,
    CASE WHEN chk <> 'checkable' THEN 'checkability:' || chk WHEN n = 0 THEN 'no_evidence' WHEN want IS NULL THEN 'any_vote_recorded' WHEN status = 'supported' THEN 'matches ' || want END AS reason,
    CASE WHEN chk = 'checkable' AND n > 0 AND status = 'contradicted' THEN want END AS expected, CASE WHEN chk = 'checkable' AND n > 0 AND status IN ('mixed', 'contradicted') THEN array_to_string(vals, ',') END AS observed FROM ver"""
)
def verdict_trace(t: demo.Tables) -> DataFrame:
    claims, ranked = ranked_votes(t)
    return verdict.decide(claims, ranked).select("claim_id", F.explode("reasons").alias("r")).select("claim_id", "r.kind", "r.reason", "r.expected", "r.observed")


@query(f"WITH {VOTES}, o AS (SELECT k, ev, row_number() OVER (PARTITION BY k ORDER BY overall DESC, list_aggregate(list_sort([p::VARCHAR, b::VARCHAR, ev]), 'string_agg', ':'), tm DESC) AS r FROM sc) SELECT ver.k::VARCHAR AS claim_id, status, coalesce(string_agg(ev, ',' ORDER BY r), '') AS top FROM ver LEFT JOIN o ON o.k = ver.k AND r <= 5 GROUP BY ALL")
def provenance_top5(t: demo.Tables) -> DataFrame:
    claims, ranked = ranked_votes(t)
    b = verdict.bundles(claims, ranked)
    return b.select("claim_id", "status", F.array_join(F.transform("top_evidence", lambda e: F.element_at(e.node_ids, "vote_event_id")), ",").alias("top"))


@query(f"WITH {VOTES} SELECT k::VARCHAR AS claim_id, count(DISTINCT doc) AS documents, CASE WHEN count(DISTINCT doc) <= 1 THEN 0.3 WHEN count(DISTINCT doc) = 2 THEN 0.7 ELSE 1.0 END::DOUBLE AS score FROM ev GROUP BY k")
def cross_source(t: demo.Tables) -> DataFrame:
    e = retrieve.vote_cast(kept(t.vote_claims(), "claims"), t.vote_kb())
    docs = e.select("claim_id", F.explode("source_document_ids").alias("d")).groupBy("claim_id").agg(F.count_distinct("d").alias("documents"))
    return docs.select("claim_id", "documents", rank.cross_source(F.col("documents")).alias("score"))


@query("SELECT l_suppkey::VARCHAR AS claim_id, l_orderkey, l_partkey, l_linenumber, rk FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS rk FROM lineitem) WHERE rk <= 3")
def topk_per_claim(t: demo.Tables) -> DataFrame:
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")]
    k = retrieve.top_k(t.lineitem, ["l_suppkey"], order, 3, rank="rk")
    return k.select(demo.s("l_suppkey").alias("claim_id"), "l_orderkey", "l_partkey", "l_linenumber", F.col("rk").cast("long").alias("rk"))


# ---------------------------------------------------------------- the other claim types


@query(
    """WITH pairs AS (SELECT l_orderkey AS k, min(struct_pack(s := l_suppkey, p := l_partkey)) AS m FROM lineitem GROUP BY 1),
    c AS (SELECT k, m.s AS s, (m.p + k % 2) AS p FROM pairs), f AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
    SELECT c.k::VARCHAR AS claim_id, CASE WHEN f.s IS NULL OR part.p_partkey IS NULL THEN 'insufficient_evidence' ELSE 'supported' END AS status, CASE WHEN f.s IS NULL OR part.p_partkey IS NULL THEN 0 ELSE 1 END::BIGINT AS n_facts, part.p_name AS title
    FROM c LEFT JOIN f USING (s, p) LEFT JOIN part ON part.p_partkey = f.p"""
)
def sponsorship_check(t: demo.Tables) -> DataFrame:
    claims = t.vote_claims().withColumns({"claim_type": F.lit("bill_sponsorship"), "checkability": F.lit("checkable"), "bill_id": (F.col("bill_id").cast("long") + F.col("claim_id").cast("long") % 2).cast("string")})
    claims = claims.withColumn("resolved_ids", demo.ids("speaker_person_id", "bill_id"))
    sponsored = t.lineitem.groupBy(demo.s("l_suppkey").alias("person_id"), demo.s("l_partkey").alias("bill_id")).agg(F.min("l_shipdate").alias("sponsored_at"))
    e = retrieve.bill_sponsorship(claims, {"sponsored": sponsored, "bill": t.bills()})
    v = verdict.decide(claims, rank.score(e, claims))
    return v.join(e.select("claim_id", "title"), "claim_id", "left").select("claim_id", "status", "n_facts", "title")


TERMS = """
terms AS (SELECT o_orderkey AS term, o_custkey AS p, c_nationkey AS org, o_orderdate AS vf, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 90 DAY END AS vt, o_orderstatus AS kind FROM orders JOIN customer ON c_custkey = o_custkey),
c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS org FROM customer)
"""
IN_SCOPE = "(vt IS NULL OR vt >= TIMESTAMP '1996-01-01') AND vf <= TIMESTAMP '1997-12-31'"


@query(f"WITH {TERMS} SELECT k::VARCHAR AS claim_id, least(count(term), 10)::BIGINT AS n_facts, CASE WHEN count(term) > 0 THEN 'supported' ELSE 'insufficient_evidence' END AS status FROM c LEFT JOIN terms ON terms.p = c.k AND terms.org = c.org AND {IN_SCOPE} GROUP BY k")
def membership_check(t: demo.Tables) -> DataFrame:
    claims = t.term_claims("committee_membership", "committee_id")
    kb = {"member_of_committee": t.terms().withColumnRenamed("org_id", "committee_id"), "committee": t.nations("committee_id")}
    v = verdict.decide(claims, rank.score(retrieve.committee_membership(claims, kb), claims))
    return v.select("claim_id", "n_facts", "status")


@query(
    f"""WITH {TERMS}, a AS (SELECT k, 'term' AS path, term, vf FROM c JOIN terms ON terms.p = c.k AND terms.org = c.org AND kind = 'F' AND {IN_SCOPE}),
    b AS (SELECT DISTINCT k, 'edge' AS path, NULL::BIGINT AS term, vf, vt FROM c JOIN terms ON terms.p = c.k AND terms.org = c.org AND kind <> 'F' AND {IN_SCOPE} WHERE NOT EXISTS (SELECT 1 FROM terms x WHERE x.kind = 'F' AND x.p = c.k AND x.org = c.org)),
    u AS (SELECT k, path FROM a UNION ALL SELECT k, path FROM b)
    SELECT c.k::VARCHAR AS claim_id, least(count(path), 10)::BIGINT AS n_facts, count(path) > 0 AND bool_and(path = 'term') AS by_term FROM c LEFT JOIN u USING (k) GROUP BY c.k"""
)
def office_check(t: demo.Tables) -> DataFrame:
    claims = t.term_claims("office_held", "office_id")
    rows = t.terms().withColumnRenamed("org_id", "office_id")
    terms = rows.where("kind = 'F'").select(F.col("term_id").alias("position_term_id"), "person_id", "office_id", F.lit("knesset").alias("appointing_body"), "valid_from", "valid_to", F.lit(False).alias("is_acting"), F.lit(None).cast("string").alias("source_document_id"))
    held = rows.where("kind <> 'F'").select("person_id", "office_id", "valid_from", "valid_to")
    e = retrieve.office_held(claims, {"position_term": terms, "office": t.nations("office_id"), "held_office": held})
    n = e.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.map_contains_key("node_ids", "position_term_id")).alias("b"))
    return claims.select("claim_id").join(n, "claim_id", "left").select("claim_id", F.coalesce("n", F.lit(0)).alias("n_facts"), F.coalesce("b", F.lit(False)).alias("by_term"))


ATTENDANCE = """
c AS (SELECT DISTINCT user_id AS p, event_type AS org FROM events),
f AS (SELECT c.p, c.org, CASE WHEN value < 20 THEN 'present' WHEN value < 40 THEN 'partial' ELSE 'absent' END AS presence, row_number() OVER (PARTITION BY c.p, c.org ORDER BY ts DESC, event_id::VARCHAR) AS rn
  FROM c JOIN events e ON e.user_id = c.p AND e.event_type = c.org WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12')
"""


@query(f"WITH {ATTENDANCE} SELECT c.p || ':' || c.org AS claim_id, count(f.p)::BIGINT AS n_facts, CASE WHEN count(f.p) = 0 THEN 'insufficient_evidence' WHEN bool_or(presence = 'present') THEN 'supported' ELSE 'contradicted' END AS status FROM c LEFT JOIN f ON f.p = c.p AND f.org = c.org AND rn <= 20 GROUP BY ALL")
def attendance_check(t: demo.Tables) -> DataFrame:
    sessions, edges = t.attendance()
    claims = t.events.select(demo.s("user_id").alias("speaker_person_id"), F.col("event_type").alias("committee_id")).distinct()
    claims = claims.withColumns({"claim_id": F.concat_ws(":", "speaker_person_id", "committee_id"), "claim_type": F.lit("committee_attendance"), "checkability": F.lit("checkable"), "time_start": F.lit("2024-01-10").cast("timestamp_ntz"), "time_end": F.lit("2024-01-12").cast("timestamp_ntz")})
    claims = claims.withColumns(demo.no_slots("expected_vote_value", "expected_seats", "expect_passed_threshold", "government_decision_id")).withColumn("resolved_ids", demo.ids("speaker_person_id", "committee_id"))
    e = retrieve.committee_attendance(claims, {"attended": edges, "attendance_event": sessions})
    return verdict.decide(claims, rank.score(e, claims)).select("claim_id", "n_facts", "status")


def uuid_sql(name: str) -> str:
    """uuid5 over the namespace, in DuckDB: sha1 of bytes, with version and variant set."""
    h = f"sha1(unhex('{keys.NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || CASE substr({h}, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


@query(f"SELECT s_suppkey, {uuid_sql("'knesset_person:' || s_suppkey")} AS person_id, {uuid_sql("'person:' || s_name")} AS name_id FROM supplier")
def entity_keys(t: demo.Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", keys.entity_key("knesset_person", F.col("s_suppkey")).alias("person_id"), keys.entity_key("person", F.col("s_name")).alias("name_id"))


LISTS = """
lists AS (SELECT n_regionkey AS r, n_nationkey AS nk, n_name, sum(l_quantity)::BIGINT AS votes FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL),
rows_ AS (SELECT *, sum(votes) OVER (PARTITION BY r)::BIGINT AS valid, 'L' || regexp_extract(n_name, '(\\d+)$', 1) AS letters FROM lists),
res AS (SELECT r, nk, n_name, letters, votes, valid, floor(votes * 120 / valid)::INT AS seats, round(printf('%.2f', votes * 100.0 / valid)::DOUBLE / 100.0, 6) AS share, votes >= ceil(valid * 0.0325) AS passed FROM rows_)
""".replace("\\\\", "\\")
PARTY = uuid_sql("CASE WHEN nk % 2 = 0 THEN 'knesset_party:' || nk ELSE 'cec_list:' || r || ':' || letters END")


@query(f"WITH {LISTS} SELECT r AS knesset_number, n_name AS list_name, {uuid_sql("'cec_election:' || r || ':' || letters")} AS election_result_id, {PARTY} AS list_party_id, votes, seats AS seats_won, share AS vote_share, passed AS passed_threshold FROM res")
def election_normalise(t: demo.Tables) -> DataFrame:
    e = adapters.election_results(t.election_rows(), t.list_mapping())
    return e.select("knesset_number", "list_name", "election_result_id", "list_party_id", "votes", "seats_won", "vote_share", "passed_threshold")


@query(f"WITH {LISTS} SELECT {PARTY} AS party_id, CASE WHEN seats = CASE WHEN nk % 3 = 0 THEN seats + 1 ELSE seats END AND (nk % 4 <> 1 OR NOT passed) THEN 'supported' ELSE 'contradicted' END AS status FROM res")
def election_check(t: demo.Tables) -> DataFrame:
    e = adapters.election_results(t.election_rows(), t.list_mapping()).withColumn("source_document_id", F.lit(None).cast("string"))
    n = F.regexp_extract("list_name", r"(\d+)$", 1).cast("int")
    claims = e.select(F.col("list_party_id").alias("claim_id"), F.col("list_party_id").alias("party_id"), (F.col("seats_won") + (n % 3 == 0).cast("int")).alias("expected_seats"), F.when(n % 4 == 1, F.lit(False)).alias("expect_passed_threshold"))
    claims = claims.withColumns({"claim_type": F.lit("election_result"), "checkability": F.lit("checkable"), "time_start": F.lit(None).cast("timestamp"), "time_end": F.lit(None).cast("timestamp"), **demo.no_slots("expected_vote_value", "government_decision_id")})
    claims = claims.withColumn("resolved_ids", demo.ids("party_id"))
    v = verdict.decide(claims, rank.score(retrieve.election_result(claims, {"election_result": e}), claims))
    return v.select(F.col("claim_id").alias("party_id"), "status")


@query(
    """WITH d AS (SELECT o_orderkey AS id, o_custkey AS num, o_orderkey % 7 AS gov, o_orderdate AS tm FROM orders),
    c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 7 END AS id, CASE WHEN c_custkey % 2 = 1 THEN c_custkey END AS num, CASE WHEN c_custkey % 5 = 1 THEN 3 END AS gov FROM customer),
    f AS (SELECT c.k, d.id, d.tm FROM c JOIN d ON c.id = d.id UNION ALL SELECT c.k, d.id, d.tm FROM c JOIN d ON c.id IS NULL AND c.num = d.num AND (c.gov IS NULL OR c.gov = d.gov)),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tm DESC, id::VARCHAR) AS rn FROM f)
    SELECT c.k::VARCHAR AS claim_id, count(r.k)::BIGINT AS n_facts, CASE WHEN count(r.k) > 0 THEN 'supported' ELSE 'insufficient_evidence' END AS status, max(r.id)::VARCHAR AS last_id FROM c LEFT JOIN r ON r.k = c.k AND rn <= 5 GROUP BY c.k"""
)
def decision_lookup(t: demo.Tables) -> DataFrame:
    k = F.col("c_custkey")
    claims = t.customer.select(
        demo.s("c_custkey").alias("claim_id"), F.lit("government_decision").alias("claim_type"), F.when(k % 2 == 0, (k * 7).cast("string")).alias("government_decision_id"), F.when(k % 2 == 1, k.cast("string")).alias("decision_number"),
        F.when(k % 5 == 1, 3).alias("government_number"), F.lit("checkable").alias("checkability"), F.lit(None).cast("timestamp").alias("time_start"), F.lit(None).cast("timestamp").alias("time_end"),
    ).withColumns(demo.no_slots("expected_vote_value", "expected_seats", "expect_passed_threshold"))
    claims = claims.withColumn("resolved_ids", F.create_map().cast("map<string,string>"))
    e = retrieve.government_decision(claims, {"government_decision": t.decisions()})
    last = e.groupBy("claim_id").agg(F.max(F.element_at("node_ids", "government_decision_id").cast("long")).cast("string").alias("last_id"))
    return verdict.decide(claims, rank.score(e, claims)).join(last, "claim_id", "left").select("claim_id", "n_facts", "status", "last_id")


@query("SELECT s_suppkey::VARCHAR AS claim_id, s_name AS canonical_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id % 150 = s_suppkey)::BIGINT AS mention_count FROM supplier")
def mention_counts(t: demo.Tables) -> DataFrame:
    claims = t.supplier.select(demo.s("s_suppkey").alias("claim_id"), demo.s("s_suppkey").alias("speaker_person_id"), F.lit("statement_about_formal_action").alias("claim_type"))
    about = t.documents.select(demo.s("doc_id").alias("span_id"), (F.col("doc_id") % 150).cast("string").alias("person_id"))
    e = retrieve.statement_about_formal_action(claims, {"person": t.supplier.select(demo.s("s_suppkey").alias("person_id"), F.col("s_name").alias("canonical_name")), "about_person": about})
    return e.select("claim_id", "canonical_name", "mention_count")


@query(f"WITH {TERMS} SELECT p::VARCHAR AS person_id, term::VARCHAR AS term_id, row_number() OVER (PARTITION BY p ORDER BY vf NULLS LAST, term::VARCHAR) AS place FROM terms WHERE vf <= TIMESTAMP '1998-06-01' AND (vt IS NULL OR vt >= TIMESTAMP '1998-06-01')")
def terms_as_of(t: demo.Tables) -> DataFrame:
    dates = t.customer.select(demo.s("c_custkey").alias("person_id"), F.lit("1998-06-01").cast("timestamp_ntz").alias("as_of"))
    return retrieve.terms_as_of(t.terms(), dates).select("person_id", "term_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {TERMS} SELECT p::VARCHAR AS person_id, count(*) AS n, min(vf)::DATE::VARCHAR AS first_day FROM terms WHERE {IN_SCOPE} GROUP BY p")
def terms_overlap(t: demo.Tables) -> DataFrame:
    scope = t.terms().withColumns({"time_start": F.lit("1996-01-01").cast("timestamp_ntz"), "time_end": F.lit("1997-12-31").cast("timestamp_ntz")})
    hit = scope.where(retrieve.overlaps(F.col("valid_from"), F.col("valid_to")))
    return hit.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.min("valid_from").cast("date").cast("string").alias("first_day"))


# ---------------------------------------------------------------- upserts and adapters


@query(
    """SELECT c_custkey AS person_id, coalesce((SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 <> 0), c_name) AS name,
    coalesce((SELECT arg_max(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P'), c_mktsegment) AS segment, least(2, (SELECT min(1 + o_orderkey % 3) FROM orders WHERE o_custkey = c_custkey))::INT AS source_tier FROM customer
    UNION ALL SELECT 1000000 + o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, (1 + o_orderkey % 3)::INT FROM orders WHERE o_orderkey % 100 = 7"""
)
def upsert_last_non_null(t: demo.Tables) -> DataFrame:
    current = t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit(2).alias("source_tier"))
    k = F.col("o_orderkey")
    batch = t.orders.select(
        F.explode(F.when(k % 100 == 7, F.array(F.col("o_custkey"), k + 1000000)).otherwise(F.array("o_custkey"))).alias("person_id"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("name"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("segment"), (k % 3 + 1).cast("int").alias("source_tier"), k.alias("seq"),
    )
    return upsert.upsert(current, batch, "person_id", "seq")


@query("SELECT o_custkey AS person_id, CASE o_orderpriority WHEN '' THEN '' ELSE o_orderpriority END AS org_id, arg_max(o_orderdate, o_orderkey)::DATE::VARCHAR AS valid_from, arg_max(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END, o_orderkey)::DATE::VARCHAR AS valid_to FROM orders GROUP BY ALL")
def edge_latest(t: demo.Tables) -> DataFrame:
    batch = t.orders.select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("org_id"), F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("valid_to"), F.col("o_orderkey").alias("seq"))
    e = upsert.merge_edges(batch.drop("seq").limit(0), batch, "person_id", "org_id", "seq", mode="latest")
    return e.select("person_id", "org_id", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"))


@query("SELECT o_custkey AS person_id, o_orderpriority AS org_id, o_orderdate::DATE::VARCHAR AS valid_from, arg_max(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END, o_orderkey)::DATE::VARCHAR AS valid_to FROM orders GROUP BY o_custkey, o_orderpriority, o_orderdate")
def edge_terms(t: demo.Tables) -> DataFrame:
    batch = t.orders.select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("org_id"), F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("valid_to"), F.col("o_orderkey").alias("seq"))
    e = upsert.merge_edges(batch.drop("seq").limit(0), batch, "person_id", "org_id", "seq")
    return e.select("person_id", "org_id", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"))


@query("SELECT DISTINCT (o_custkey * 2)::BIGINT AS person_id, NULL::VARCHAR AS name FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def stub_rows(t: demo.Tables) -> DataFrame:
    people = t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    return upsert.stub_rows(t.orders.select((F.col("o_custkey") * 2).alias("person_id")), "person_id", people)


@query("SELECT count(*) AS n, count(DISTINCT l_suppkey) AS people FROM lineitem WHERE l_suppkey % 2 = 0 AND l_partkey % 3 = 0 AND l_returnflag <> 'N'")
def edge_guards(t: demo.Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_suppkey").alias("person_id"), F.col("l_partkey").alias("bill_id"), F.when(F.col("l_returnflag") != "N", demo.vote_value()).otherwise("absent").alias("value"))
    people = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("person_id"))
    bills = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("bill_id"))
    return upsert.with_endpoints(upsert.guarded(edges), "person_id", people, "bill_id", bills).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("person_id").alias("people"))


@query(
    """WITH ev AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS bill, o_orderdate AS tm FROM orders), h AS (SELECT * FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 2500 END AS bill, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS tm FROM orders) WHERE bill IS NOT NULL)
    SELECT ev.id AS vote_event_id, coalesce(h.bill, ev.bill) AS bill_id, coalesce(h.tm, ev.tm)::DATE::VARCHAR AS occurred_at, p_partkey IS NOT NULL AS linked FROM ev LEFT JOIN h USING (id) LEFT JOIN part ON p_partkey = h.bill"""
)
def enrich_votes(t: demo.Tables) -> DataFrame:
    k = F.col("o_orderkey")
    events = t.orders.select(k.alias("vote_event_id"), F.when(k % 2 == 0, F.col("o_custkey")).alias("bill_id"), F.col("o_orderdate").alias("occurred_at"), F.lit("roll").alias("vote_type"))
    headers = t.orders.select(k.alias("vote_event_id"), F.when(k % 5 == 0, F.col("o_custkey") % 2500).alias("bill_id"), F.when(k % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("occurred_at"), F.lit(None).cast("string").alias("vote_type"))
    updated, edges, _ = adapters.enrich_votes(events, headers, t.part.select(F.col("p_partkey").alias("bill_id")))
    linked = edges.select("vote_event_id", F.lit(True).alias("linked")).distinct()
    return updated.join(linked, "vote_event_id", "left").select("vote_event_id", "bill_id", day("occurred_at").alias("occurred_at"), F.coalesce("linked", F.lit(False)).alias("linked"))


@query(
    f"SELECT l_orderkey, l_linenumber, {uuid_sql("'knesset_vote:' || l_orderkey")} AS vote_event_id, {uuid_sql("'knesset_person:' || l_suppkey")} AS person_id, CASE l_linenumber % 5 WHEN 1 THEN 'for' WHEN 2 THEN 'against' WHEN 3 THEN 'abstain' END AS value, count(*) AS n FROM lineitem WHERE l_orderkey > 0 GROUP BY ALL"
)
def votes_normalise(t: demo.Tables) -> DataFrame:
    code = F.col("l_linenumber") % 5
    raw = t.lineitem.select("l_orderkey", "l_linenumber", demo.s("l_orderkey").alias("vote_id"), F.lpad(demo.s("l_suppkey"), 9, "0").alias("kmmbr_id"), F.lit(" x ").alias("kmmbr_name"), F.when(code == 4, "bad").otherwise(code.cast("string")).alias("vote_result"))
    v = adapters.votes(raw, keep=("l_orderkey", "l_linenumber"))
    return v.groupBy("l_orderkey", "l_linenumber", "vote_event_id", "person_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH b AS (SELECT *, o_orderkey % 70 AS code, o_custkey % 40 AS gov, CASE o_orderkey % 70 WHEN 30 THEN 'prime_minister' WHEN 39 THEN 'committee_chair' WHEN 42 THEN 'committee_member' WHEN 43 THEN 'mk' WHEN 48 THEN 'deputy_speaker' WHEN 49 THEN 'minister' WHEN 50 THEN 'deputy_prime_minister'
      WHEN 51 THEN 'deputy_minister' WHEN 54 THEN 'mk' WHEN 61 THEN 'mk' WHEN 65 THEN 'committee_chair' WHEN 67 THEN 'committee_member' ELSE o_orderpriority END AS kind FROM orders WHERE o_orderkey > 0 AND o_custkey > 0 AND o_orderstatus <> 'P')
    SELECT {uuid_sql("'knesset_position_term:' || o_orderkey")} AS position_term_id, {uuid_sql("'knesset_office:' || code || ':' || CASE WHEN gov = 0 THEN '-' ELSE gov::VARCHAR END")} AS office_id, kind AS office_type,
      CASE WHEN kind IN ('prime_minister', 'minister', 'deputy_prime_minister', 'deputy_minister') THEN 'government' ELSE 'knesset' END AS appointing_body,
      CASE WHEN kind IN ('prime_minister', 'minister', 'deputy_prime_minister', 'deputy_minister') AND gov <> 0 THEN 'ministry ' || gov ELSE o_orderpriority END AS canonical_name FROM b"""
)
def positions_lanes(t: demo.Tables) -> DataFrame:
    gov = F.col("o_custkey") % 40
    raw = t.orders.select(
        F.col("o_orderkey").alias("PersonToPositionID"), F.col("o_custkey").alias("PersonID"), (F.col("o_orderkey") % 70).cast("int").alias("PositionID"), F.col("o_custkey").alias("FactionID"), F.lit("f").alias("FactionName"), gov.alias("GovMinistryID"),
        F.when(gov != 0, F.concat(F.lit("ministry "), gov.cast("string"))).alias("GovMinistryName"), F.col("o_orderpriority").alias("DutyDesc"), F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("StartDate"), F.lit(None).cast("string").alias("FinishDate"),
    )
    lanes = adapters.positions(raw, keep=("PersonToPositionID",))
    j = lanes["term"].select("PersonToPositionID", "position_term_id", "office_id", "appointing_body").join(lanes["office"].select("PersonToPositionID", "office_type", "canonical_name"), "PersonToPositionID")
    return j.select("position_term_id", "office_id", "office_type", "appointing_body", "canonical_name")


@query(
    f"""WITH l AS (SELECT c_custkey AS m FROM customer WHERE c_custkey % 3 <> 0), a AS (SELECT o_orderkey AS s, unnest([o_custkey, o_custkey + 1]) AS m, o_orderstatus AS st FROM orders WHERE o_orderkey > 0 AND o_orderstatus <> 'P')
    SELECT {uuid_sql("'knesset_session:' || s")} AS attendance_event_id, {uuid_sql("'knesset_person:' || m")} AS person_id, 'present' AS presence FROM a JOIN l USING (m)"""
)
def attendee_explode(t: demo.Tables) -> DataFrame:
    ids_ = F.when(F.col("o_orderstatus") == "P", "[broken").otherwise(F.concat(F.lit('["'), demo.s("o_custkey"), F.lit('", "'), (F.col("o_custkey") + 1).cast("string"), F.lit('", ""]')))
    raw = t.orders.select(F.col("o_orderkey").alias("CommitteeSessionID"), F.lit(5).alias("CommitteeID"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("StartDate"), ids_.alias("attended_mk_individual_ids"))
    lookup = t.customer.where("c_custkey % 3 <> 0").select(demo.s("c_custkey").alias("mk_individual_id"), F.col("c_custkey").alias("PersonID"))
    _, edges = adapters.attendance(raw, lookup)
    return edges.select("attendance_event_id", "person_id", "presence")


# ---------------------------------------------------------------- entity resolution


def name_entities(t: demo.Tables) -> DataFrame:
    """Bills by their names, which repeat (ambiguity for free), with part of them kept unique by a suffix."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_name", demo.letters(demo.s("p_partkey")))).otherwise(F.col("p_name"))
    return t.part.select(F.lit("bill").alias("kind"), demo.s("p_partkey").alias("entity_id"), name.alias("canonical_name"), name.alias("hebrew_name"), name.alias("english_name"), F.create_map(F.lit("src"), demo.s("p_partkey")).alias("external_ids"))


LETTERS = "translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij')"
NAMES = f"e AS (SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || {LETTERS} ELSE p_name END AS name FROM part)"


def name_mentions(t: demo.Tables) -> DataFrame:
    e = name_entities(t)
    return e.select(F.concat(F.lit("m"), "entity_id").alias("mention_id"), "kind", F.concat(F.lit("  "), "canonical_name", F.lit(" ")).alias("hebrew_name"), F.lit(None).cast("string").alias("english_name"))


@query(f"WITH {NAMES}, u AS (SELECT name, min(id) AS id FROM e GROUP BY name HAVING count(*) = 1) SELECT 'm' || e.id AS mention_id, u.id AS entity_id, 95 AS score FROM e JOIN u USING (name)")
def resolve_exact(t: demo.Tables) -> DataFrame:
    return resolve.by_exact_name(name_mentions(t), name_entities(t)).select("mention_id", "entity_id", "score")


@query("SELECT 'm' || s_suppkey AS mention_id, s_suppkey::VARCHAR AS entity_id, greatest(s_suppkey % 120 - 10, 0)::INT AS score FROM supplier")
def resolve_alias(t: demo.Tables) -> DataFrame:
    aliases = t.supplier.select(F.lit("person").alias("entity_kind"), F.lower("s_name").alias("alias_text"), F.lit("en").alias("alias_locale"), demo.s("s_suppkey").alias("canonical_entity_id"), (F.col("s_suppkey") % 120).cast("int").alias("confidence"))
    m = t.supplier.select(F.concat(F.lit("m"), demo.s("s_suppkey")).alias("mention_id"), F.lit("person").alias("kind"), F.concat(F.lit(" "), F.upper("s_name")).alias("english_name"))
    return resolve.by_alias(m, aliases, F.lower(F.trim("english_name")), "en", 4, "transliteration", 10).select("mention_id", "entity_id", "score")


@query("WITH m AS (SELECT 'm' || n_nationkey AS id, lower(n_name) AS t FROM nation), h AS (SELECT m.id, min(n.n_nationkey) AS e, count(DISTINCT n.n_nationkey) AS k FROM m JOIN nation n ON contains(lower(n.n_name), m.t) GROUP BY m.id) SELECT id AS mention_id, e::VARCHAR AS entity_id FROM h WHERE k = 1")
def resolve_contains(t: demo.Tables) -> DataFrame:
    m = t.nation.select(F.concat(F.lit("m"), demo.s("n_nationkey")).alias("mention_id"), F.lit("party").alias("kind"), F.lit(None).cast("string").alias("hebrew_name"), F.lower("n_name").alias("english_name"))
    names = t.nation.select(F.lit("party").alias("kind"), demo.s("n_nationkey").alias("entity_id"), F.col("n_name").alias("name"))
    return resolve.by_substring(m, names).select("mention_id", "entity_id")


@query(f"WITH {NAMES}, al AS (SELECT name, id FROM e WHERE id::BIGINT % 2 = 1), c AS (SELECT e.id AS m, al.id AS x FROM e JOIN al USING (name)) SELECT 'm' || e.id AS mention_id, CASE WHEN count(DISTINCT x) = 0 THEN 'unresolved' WHEN count(DISTINCT x) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT x) = 1 THEN min(x) END AS entity_id, count(DISTINCT x) AS candidates FROM e LEFT JOIN c ON c.m = e.id GROUP BY e.id")
def resolve_unique(t: demo.Tables) -> DataFrame:
    aliases = name_entities(t).where("entity_id % 2 = 1").select(F.col("kind").alias("entity_kind"), F.col("canonical_name").alias("alias_text"), F.lit("he").alias("alias_locale"), F.col("entity_id").alias("canonical_entity_id"), F.lit(90).alias("confidence"))
    m, texts = resolve.with_texts(name_mentions(t))
    c = resolve.by_alias(texts, aliases, text.normalize_hebrew(F.col("hebrew_name")), "he", 3, "alias_he")
    found = resolve.decide(texts, c).select(F.col("mention_id").alias("_text"), "status", "entity_id", F.col("n_candidates").alias("candidates"))
    return m.select("mention_id", "_text").join(found, "_text").drop("_text")


@query()
def resolve_fuzzy(t: demo.Tables) -> DataFrame:
    """Supplier names with a slip against all supplier names of their nation."""
    e = t.supplier.select(F.concat(F.lit("n"), demo.s("s_nationkey")).alias("kind"), demo.s("s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"), F.lit(None).cast("string").alias("hebrew_name"), F.col("s_name").alias("english_name"))
    m = e.select(F.concat(F.lit("m"), "entity_id").alias("mention_id"), "kind", "hebrew_name", F.concat(F.substring("english_name", 1, 3), F.lit("x"), F.substring("english_name", 5, 99)).alias("english_name"))
    c = resolve.by_similarity(m, e)
    return resolve.decide(m, c).select("mention_id", "status", "entity_id", "top_score")


# ---------------------------------------------------------------- time and text


PHRASE = """CASE o_orderkey % 6 WHEN 0 THEN o_orderdate::DATE::VARCHAR WHEN 1 THEN 'in ' || year(o_orderdate) WHEN 2 THEN 'the ' || (o_custkey % 30) || 'th Knesset' WHEN 3 THEN 'last year' WHEN 4 THEN 'last term' ELSE 'soon' END"""
CALENDAR = "cal(n, s, e) AS (VALUES " + ", ".join(f"({n}, DATE '{a}', {f"DATE '{b}'" if b else 'NULL::DATE'})" for n, a, b in timescope.TERM_CALENDAR) + ")"


@query(
    f"""WITH {CALENDAR}, p AS (SELECT o_orderkey AS k, {PHRASE} AS phrase, o_orderdate::DATE AS ref, o_custkey FROM orders),
    x AS (SELECT p.*, CASE k % 6 WHEN 2 THEN o_custkey % 30 WHEN 4 THEN (SELECT min(n) FROM cal WHERE ref >= s AND (e IS NULL OR ref <= e)) - 1 END AS term FROM p)
    SELECT k, phrase, CASE k % 6 WHEN 0 THEN ref WHEN 1 THEN make_date(year(ref), 1, 1) WHEN 3 THEN make_date(year(ref) - 1, 1, 1) ELSE c.s END::VARCHAR AS first_day,
      CASE k % 6 WHEN 0 THEN ref WHEN 1 THEN make_date(year(ref), 12, 31) WHEN 3 THEN make_date(year(ref) - 1, 12, 31) ELSE c.e END::VARCHAR AS last_day,
      CASE k % 6 WHEN 0 THEN 'day' WHEN 1 THEN 'year' WHEN 3 THEN 'year' WHEN 5 THEN 'unknown' ELSE CASE WHEN c.n IS NULL THEN 'unknown' ELSE 'term' END END AS granularity
    FROM x LEFT JOIN cal c ON c.n = x.term"""
)
def time_scopes(t: demo.Tables) -> DataFrame:
    k = F.col("o_orderkey")
    phrase = (
        F.when(k % 6 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 6 == 1, F.concat(F.lit("in "), F.year("o_orderdate").cast("string"))).when(k % 6 == 2, F.concat(F.lit("the "), (F.col("o_custkey") % 30).cast("string"), F.lit("th Knesset")))
        .when(k % 6 == 3, "last year").when(k % 6 == 4, "last term").otherwise("soon")
    )
    d = t.orders.select(k.alias("k"), phrase.alias("phrase"), F.to_date("o_orderdate").alias("ref")).withColumn("x", timescope.normalize_time_scope(F.col("phrase"), F.col("ref")))
    return d.select("k", "phrase", day("x.start").alias("first_day"), day("x.end").alias("last_day"), F.col("x.granularity").alias("granularity"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE::VARCHAR WHEN 1 THEN make_date(year(o_orderdate), 1, 1)::VARCHAR END AS day FROM orders")
def utterance_times(t: demo.Tables) -> DataFrame:
    k = F.col("o_orderkey")
    txt = F.concat(F.lit("said on "), F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, F.concat(F.year("o_orderdate").cast("string"), F.lit("!"))).otherwise("12345"))
    return t.orders.select(k.alias("k"), timescope.utterance_time(txt).cast("date").cast("string").alias("day"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'for' WHEN 'view' THEN 'against' WHEN 'error' THEN 'abstain' END AS value FROM events")
def vote_words(t: demo.Tables) -> DataFrame:
    word = F.when(F.col("event_type") == "click", " In favor of").when(F.col("event_type") == "view", "OPPOSED ").when(F.col("event_type") == "error", "to abstain").otherwise(F.col("event_type"))
    return t.events.select("event_id", text.vote_value(word).alias("value"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN greatest(60, 60 * (user_id % 40))::INT WHEN 1 THEN 3600 WHEN 2 THEN 86400 WHEN 3 THEN 86400 END AS seconds FROM events")
def cadence(t: demo.Tables) -> DataFrame:
    k = F.col("event_id") % 5
    cron = F.when(k == 0, F.concat(F.lit("*/"), (F.col("user_id") % 40).cast("string"), F.lit(" * * * *"))).when(k == 1, "5 * * * *").when(k == 2, "5  4 * * *").when(k == 3, "5 4 * * 1").otherwise("5 4 *")
    return t.events.select("event_id", text.cadence_seconds(cron).alias("seconds"))


# ---------------------------------------------------------------- claim extraction


def _sentences_sql() -> str:
    return """sen AS (SELECT l_orderkey || '-' || l_suppkey || '-' || l_partkey || '-' || l_linenumber || '-' || strftime(l_shipdate, '%Y%m%d') AS id, l_shipdate,
      translate(regexp_replace(s_name, '[#_]', '', 'g'), '0123456789', 'abcdefghij') || ' ' || CASE l_orderkey % 4 WHEN 0 THEN 'voted for the' WHEN 1 THEN 'voted against the' WHEN 2 THEN 'sponsored the' ELSE 'abstained from the' END || ' ' || translate(regexp_replace(p_name, '[#_]', '', 'g'), '0123456789', 'abcdefghij') || ' bill'
      || CASE WHEN l_suppkey % 2 = 0 THEN ' in ' || year(l_shipdate) ELSE CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' in the 18th Knesset' ELSE ' in last term' END END || '.' AS text
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"""


def _rule_sql(name: str) -> str:
    r = next(x for x in extract.RULES if x.name == name)
    return r.re2().replace("'", "''")


def _claims_sql() -> str:
    v, sp = _rule_sql("R6"), _rule_sql("R7")
    return f"""{_sentences_sql()}, cl AS (
      SELECT id, text, l_shipdate, 'vote_cast' AS claim_type, trim(regexp_extract(text, '{v}', 1)) AS speaker, CASE lower(regexp_extract(text, '{v}', 2)) WHEN 'for' THEN 'for' WHEN 'against' THEN 'against' END AS vote, trim(regexp_extract(text, '{v}', 3)) AS bill, nullif(regexp_extract(text, '{v}', 4), '') AS time_phrase FROM sen WHERE regexp_matches(text, '{v}')
      UNION ALL SELECT id, text, l_shipdate, 'bill_sponsorship', trim(regexp_extract(text, '{sp}', 1)), NULL, trim(regexp_extract(text, '{sp}', 2)), nullif(regexp_extract(text, '{sp}', 3), '') FROM sen WHERE regexp_matches(text, '{sp}'))"""


@query(f"WITH {_claims_sql()} SELECT id AS statement_id, claim_type, speaker AS speaker_person_id, vote AS vote_value, bill AS bill_id, time_phrase FROM cl")
def extract_claims(t: demo.Tables) -> DataFrame:
    claims, _ = extract.extract(t.sentences(), F.to_date(F.lit("2024-06-01")))
    return claims.select("statement_id", "claim_type", "speaker_person_id", "vote_value", "bill_id", "time_phrase")


@query(f"WITH {_claims_sql()} SELECT sen.id AS statement_id, count(cl.id)::INT AS rule_matches, count(cl.id)::INT AS n_claims FROM sen LEFT JOIN cl USING (id) GROUP BY sen.id")
def extract_summary(t: demo.Tables) -> DataFrame:
    _, summary = extract.extract(t.sentences(), F.to_date(F.lit("2024-06-01")))
    return summary.select("statement_id", F.col("rule_matches").cast("int").alias("rule_matches"), F.col("n_claims").cast("int").alias("n_claims"))


@query(f"WITH {_claims_sql()} SELECT id AS statement_id, CASE WHEN claim_type = 'vote_cast' AND time_phrase IS NULL THEN 'insufficient_time_scope' ELSE 'checkable' END AS checkability FROM cl")
def checkability(t: demo.Tables) -> DataFrame:
    claims, _ = extract.extract(t.sentences(), F.to_date(F.lit("2024-06-01")))
    c = resolve.resolve_claims(claims, None, None)
    return c.select("statement_id", extract.claim_checkability(c).alias("checkability"))


@query(
    f"""WITH {_claims_sql()}, d AS (SELECT sen.id, cl.claim_type, CASE WHEN claim_type = 'vote_cast' AND time_phrase IS NULL THEN 'insufficient_time_scope' WHEN claim_type IS NOT NULL THEN 'checkable' END AS chk FROM sen LEFT JOIN cl USING (id))
    SELECT id AS declaration_id, CASE WHEN claim_type IS NULL THEN 'unknown' ELSE 'formal_action' END AS claim_family, CASE WHEN chk IS NULL THEN 'not_checkable' WHEN chk = 'checkable' THEN 'checkable_formal_action' ELSE chk END AS checkability, CASE WHEN chk IS NULL THEN 0 ELSE 1 END::INT AS n_claims FROM d"""
)
def declaration_check(t: demo.Tables) -> DataFrame:
    u = t.sentences()
    claims, _ = extract.extract(u, F.to_date(F.lit("2024-06-01")))
    c = resolve.resolve_claims(claims, None, None)
    c = c.withColumn("checkability", extract.claim_checkability(c))
    d = extract.declarations(u.withColumnRenamed("statement_id", "declaration_id"), c)
    return d.select("declaration_id", "claim_family", "checkability", F.size("derived_atomic_claim_ids").alias("n_claims"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END::INT AS violations FROM orders")
def slot_check(t: demo.Tables) -> DataFrame:
    k = F.col("o_orderkey")
    d = t.orders.select(k.alias("k"), F.lit("vote_cast").alias("claim_type"), F.lit("p").alias("speaker_person_id"), F.when(k % 4 != 1, "b").alias("bill_id"), F.when(k % 4 != 3, "for").alias("vote_value"), F.when(k % 4 >= 2, "o").alias("office_id"))
    d = d.withColumns(demo.no_slots("target_person_id", "committee_id", "party_id", "expected_seats", "expect_passed_threshold", "government_decision_id"))
    return d.select("k", F.size(extract.violations(F.col("claim_type"), {c: F.col(c) for c in extract.SLOTS})).alias("violations"))


@query(
    """WITH d AS (SELECT o_orderkey AS k, (o_orderkey % 3000)::VARCHAR AS n, (o_custkey % 100)::VARCHAR AS m FROM orders), x AS (SELECT *, 'החלטת ממשלה מספר ' || n || ', ' AS one, 'בהחלטה מספר ' || m || '.' AS two FROM d)
    SELECT k::VARCHAR AS statement_id, 'government_decision' AS claim_type, n AS government_decision_id, 0::INT AS span_start, length(one)::INT AS span_end FROM x UNION ALL SELECT k::VARCHAR, 'government_decision', m, length(one)::INT, (length(one) + length(two))::INT FROM x"""
)
def claim_overlap(t: demo.Tables) -> DataFrame:
    """Sentences with two decision references; overlapping matches of two rules are resolved."""
    n = (F.col("o_orderkey") % 3000).cast("string")
    d = t.orders.select(demo.s("o_orderkey").alias("statement_id"), F.concat(F.lit("החלטת ממשלה מספר "), n, F.lit(", בהחלטה מספר "), (F.col("o_custkey") % 100).cast("string"), F.lit(".")).alias("text"), F.lit("he").alias("language"))
    claims, _ = extract.extract(d, F.to_date(F.lit("2024-06-01")))
    return claims.select("statement_id", "claim_type", "government_decision_id", "span_start", "span_end")


# ---------------------------------------------------------------- text and vectors


TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


@query(
    f"""WITH d AS (SELECT doc_id, {TOKENS.format("coalesce(text, '')")} AS t FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM d),
    p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS tok FROM d), tf AS (SELECT tok, doc_id, dl, count(*) AS tf FROM p GROUP BY ALL), q AS (SELECT item_id, unnest({TOKENS.format('text')}) AS tok FROM benchmark),
    w AS (SELECT tf.*, ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / st.avgdl)) AS w FROM tf JOIN (SELECT tok, count(*) AS df FROM tf GROUP BY tok) USING (tok), st),
    s AS (SELECT item_id, doc_id, round(sum(w), 6) AS score FROM q JOIN w USING (tok) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM s) SELECT item_id, doc_id, score::DOUBLE AS score, rk FROM r WHERE rk <= 10"""
)
def bm25(t: demo.Tables) -> DataFrame:
    s = lexical.bm25(t.benchmark.select("item_id", F.col("text").alias("q")), t.documents, "item_id", "q", "doc_id", "text")
    s = s.withColumn("score", F.round("score", 6))
    return retrieve.top_k(s, ["item_id"], [F.col("score").desc(), F.col("doc_id")], 10, rank="rk").withColumn("rk", F.col("rk").cast("long"))


@query(
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS m FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, n.vec_id, round(list_inner_product(q.v, n.v) / (q.m * n.m), 6) AS score FROM n q JOIN n ON q.vec_id % 100 = 0 AND q.vec_id <> n.vec_id WHERE q.m > 0 AND n.m > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10"""
)
def knn_exact(t: demo.Tables) -> DataFrame:
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return lexical.knn_exact(q, t.embeddings, 10, digits=6).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query()
def knn_hashed(t: demo.Tables) -> DataFrame:
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return lexical.knn_hashed(q, t.embeddings, 10)


def source_documents(t: demo.Tables) -> DataFrame:
    return t.documents.select(
        demo.s("doc_id").alias("document_id"), F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("text")).alias("title"), F.col("text").alias("body"), F.when(F.col("doc_id") % 3 == 0, 1).alias("source_tier"), F.lit("web").alias("source_type"), F.col("source").alias("url"),
        F.lit(None).cast("string").alias("archive_uri"), F.lit(None).cast("timestamp").alias("captured_at"), F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"),
    )


@query(f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '.' ELSE coalesce(nullif(trim(text, ' '), ''), '.') END AS t FROM documents) SELECT {uuid_sql("'evidence_span:' || doc_id")} AS span_id, doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS source_tier, t AS text, length(t)::INT AS char_end FROM d")
def span_index(t: demo.Tables) -> DataFrame:
    return archive.build_span_index(source_documents(t)).select("span_id", "document_id", "source_tier", "text", "char_end")


@query(f"WITH a AS (SELECT doc_id, text, substr(text, 20, 15) AS a FROM documents), p AS (SELECT *, instr(text, a) - 1 AS s FROM a WHERE length(a) > 0) SELECT doc_id::VARCHAR AS document_id, s::INT AS char_start, (s + length(a))::INT AS char_end, {uuid_sql("'span:' || sha256(text) || ':' || s || ':' || (s + length(a))")} AS span_id FROM p WHERE s >= 0")
def anchored_spans(t: demo.Tables) -> DataFrame:
    anchors = t.documents.select(demo.s("doc_id").alias("document_id"), F.substring("text", 20, 15).alias("anchor"))
    return archive.extract_spans(source_documents(t), anchors).select("document_id", "char_start", "char_end", "span_id")


TEXTS = "SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations"


@query(f"WITH f AS (SELECT id, sha256(text) AS h, row_number() OVER (PARTITION BY text ORDER BY id) AS k FROM ({TEXTS}) WHERE text IS NOT NULL), old AS (SELECT DISTINCT sha256(text) AS h FROM conversations) SELECT id, f.h AS content_sha256, k = 1 AND old.h IS NULL AS created FROM f LEFT JOIN old USING (h)")
def content_dedup(t: demo.Tables) -> DataFrame:
    """All documents and turns fetched again after all turns were archived."""
    rows = t.documents.select(F.concat(F.lit("d"), demo.s("doc_id")).alias("id"), "text").unionByName(t.conversations.select(F.concat(F.lit("c"), demo.s("conv_id"), F.lit("-"), demo.s("turn")).alias("id"), "text"))
    f = rows.where("text IS NOT NULL").select("id", F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("content_type"), F.lit("statements").alias("family"), F.col("id").alias("source_url"), F.lit("2024-02-03 01:02:03").cast("timestamp").alias("captured_at"), F.lit(2).alias("source_tier"), F.col("id").alias("seq"))
    _, old = archive.archive(f.where(F.col("id").startswith("c")), t.spark.createDataFrame([], "content_sha256 string, archive_uri string"))
    answers, _ = archive.archive(f, old.select("content_sha256", "archive_uri"))
    return answers.select("id", "content_sha256", "created")


@query("SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN 's3://archive/' || CASE doc_id % 2 WHEN 0 THEN 'gov_il' ELSE 'elections' END || '/2024/02/' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '/' || sha256(text) || '.' || CASE doc_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'html' ELSE 'bin' END END AS uri, doc_id % 9 <> 0 AS valid FROM documents")
def archive_uris(t: demo.Tables) -> DataFrame:
    k = F.col("doc_id")
    at = F.concat(F.lit("2024-02-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" 12:00:00")).cast("timestamp")
    family = F.when(k % 9 == 0, "unknown").when(k % 2 == 0, "gov_il").otherwise("elections")
    ext = archive.extension(F.when(k % 3 == 0, "Application/JSON; charset=utf-8").when(k % 3 == 1, "text/html"))
    d = t.documents.select("doc_id", archive.archive_uri(family, at, F.sha2(F.col("text").cast("binary"), 256), ext).alias("uri"))
    return d.select("doc_id", "uri", F.coalesce(archive.parse_archive_uri(F.col("uri")).valid, F.lit(False)).alias("valid"))


@query("""WITH i AS (SELECT page_id, regexp_extract_all(html, '(?s)<li><a href="([^"]*)">[^<]*</a></li>') AS m FROM pages), r AS (SELECT page_id, unnest(range(0, len(m))) AS pos, m FROM i) SELECT page_id, pos::INT AS pos, regexp_extract(m[pos + 1], 'href="([^"]*)"', 1) AS href, trim(regexp_replace(m[pos + 1], '<[^>]+>', '', 'g')) AS label FROM r""")
def page_rows(t: demo.Tables) -> DataFrame:
    return readers.page_links(t.pages).select("page_id", F.col("at").alias("pos"), "href", "label")


# ---------------------------------------------------------------- attribution and review


STATUS = "['supported', 'contradicted', 'mixed', 'insufficient_evidence', 'non_checkable']"


def relation_rows(t: demo.Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = demo.pick(k % 5, "supported", "contradicted", "mixed", "insufficient_evidence", "non_checkable")
    chk = demo.pick(k % 3, "checkable", "insufficient_entity_resolution", "insufficient_time_scope")
    why = F.array(verdict.reason("contradict", F.when(k % 7 == 0, "time_scope_outside").otherwise("other")))
    return t.orders.select(k.alias("k"), F.col("o_custkey").alias("declaration_id"), status.alias("status"), attribution.relation(status, chk, why, k % 2).alias("relation_type"), attribution.band((k % 101) / 100.0).alias("band"))


RELATIONS = """rel AS (SELECT o_orderkey AS k, o_custkey AS declaration_id, CASE o_orderkey % 5 WHEN 0 THEN 'supported_by' WHEN 1 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'time_scope_mismatch' ELSE 'contradicted_by' END WHEN 2 THEN CASE WHEN o_orderkey % 2 = 1 THEN 'underspecifies' ELSE 'overstates' END
  WHEN 3 THEN 'not_checkable_against_record' ELSE CASE o_orderkey % 3 WHEN 1 THEN 'entity_ambiguous' WHEN 2 THEN 'time_scope_mismatch' ELSE 'not_checkable_against_record' END END AS relation_type,
  CASE WHEN o_orderkey % 101 >= 80 THEN 'high' WHEN o_orderkey % 101 >= 60 THEN 'medium' WHEN o_orderkey % 101 >= 45 THEN 'low' ELSE 'uncertain' END AS band FROM orders)"""


@query(f"WITH {RELATIONS} SELECT k, relation_type FROM rel")
def relations(t: demo.Tables) -> DataFrame:
    return relation_rows(t).select("k", "relation_type")


@query(f"WITH {RELATIONS} SELECT k, band FROM rel")
def bands(t: demo.Tables) -> DataFrame:
    return relation_rows(t).select("k", "band")


@query(f"WITH {RELATIONS}, o(r, i) AS (VALUES {', '.join(f"('{r}', {i})" for i, r in enumerate(attribution.WORST_FIRST))}) SELECT declaration_id, arg_min(relation_type, i) AS overall_relation FROM rel JOIN o ON r = relation_type GROUP BY declaration_id")
def worst_relation(t: demo.Tables) -> DataFrame:
    return relation_rows(t).groupBy("declaration_id").agg(attribution.worst(F.col("relation_type")).alias("overall_relation"))


def review_tables(t: demo.Tables) -> tuple[DataFrame, DataFrame]:
    """Orders as tasks, their lines as actions."""
    tasks = t.orders.select(demo.s("o_orderkey").alias("task_id"), demo.pick(F.col("o_orderkey") % 3, "verdict", "conflict", "declaration").alias("kind"), F.when(F.col("o_orderkey") % 50 == 0, "resolved").otherwise("open").alias("status"), (F.col("o_custkey") % 10).cast("int").alias("priority"), F.lit('{"machine_verdict":"mixed"}').alias("payload"), F.lit(None).cast("string").alias("assigned_to"))
    action = demo.pick(F.col("l_partkey") % 6, "approve", "annotate", "escalate", "annotate", "reject", "unknown")
    actions = t.lineitem.select(demo.s("l_orderkey").alias("task_id"), (F.col("l_suppkey") * 100000 + F.col("l_partkey")).alias("action_seq"), demo.s("l_suppkey").alias("actor"), action.alias("action"), F.lit(None).cast("string").alias("notes"))
    return tasks, actions


ACTIONS = """t AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'verdict' WHEN 1 THEN 'conflict' ELSE 'declaration' END AS kind, CASE WHEN o_orderkey % 50 = 0 THEN 'resolved' ELSE 'open' END AS st, (o_custkey % 10)::INT AS priority FROM orders),
a AS (SELECT l_orderkey AS id, l_suppkey * 100000 + l_partkey AS seq, l_suppkey AS actor, CASE l_partkey % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' WHEN 2 THEN 'escalated' WHEN 3 THEN 'open' WHEN 4 THEN 'resolved' END AS to_, l_partkey % 6 AS code FROM lineitem WHERE l_partkey % 6 <> 5),
e AS (SELECT id, min(CASE WHEN to_ <> 'open' THEN seq END) AS fin FROM a GROUP BY id),
l AS (SELECT a.id, arg_max(to_, seq) AS to_, arg_max(actor, seq) AS actor FROM a JOIN e USING (id) WHERE fin IS NULL OR seq <= fin GROUP BY a.id)"""


@query(f"WITH {ACTIONS} SELECT t.id::VARCHAR AS task_id, CASE WHEN st = 'resolved' OR l.to_ IS NULL THEN st ELSE l.to_ END AS status, CASE WHEN st = 'resolved' THEN NULL ELSE l.actor END::VARCHAR AS assigned_to FROM t LEFT JOIN l USING (id)")
def review_fold(t: demo.Tables) -> DataFrame:
    return review.fold(*review_tables(t)).select("task_id", "status", "assigned_to")


@query(f"WITH {ACTIONS} SELECT a.id::VARCHAR AS task_id, seq AS action_seq, st = 'open' AND (fin IS NULL OR seq <= fin) AND code = 4 AND kind = 'verdict' AS verdict_reviewer_override FROM a JOIN t USING (id) JOIN e USING (id)")
def review_audit(t: demo.Tables) -> DataFrame:
    return review.audit(*review_tables(t)).select("task_id", "action_seq", "verdict_reviewer_override")


@query("SELECT o_orderkey::VARCHAR AS task_id, (o_custkey % 10)::INT AS priority FROM orders WHERE o_orderkey % 50 <> 0 ORDER BY priority DESC, task_id LIMIT 50")
def review_queue(t: demo.Tables) -> DataFrame:
    return review.pending(review_tables(t)[0], 50).select("task_id", "priority")


@query(f"WITH {VOTES} SELECT k::VARCHAR AS claim_id, n AS n_tier1_any FROM ver WHERE status = 'mixed'")
def conflicts(t: demo.Tables) -> DataFrame:
    claims, ranked = ranked_votes(t)
    tasks = review.conflict_tasks(verdict.decide(claims, ranked))
    return tasks.select(F.get_json_object("payload", "$.claim_id").alias("claim_id"), F.get_json_object("payload", "$.n_tier1_any").cast("long").alias("n_tier1_any"))


# ---------------------------------------------------------------- quality, evaluation, freshness


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(t: demo.Tables) -> DataFrame:
    return quality.duplicate_keys(t.orders, ["o_custkey"])


@query("SELECT o_orderkey, 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::VARCHAR FROM orders WHERE o_custkey > 1000")
def domain_violations(t: demo.Tables) -> DataFrame:
    return quality.domain_violations(t.orders, "o_orderkey", {"o_orderstatus": ["O", "F"]}, {"o_custkey": (0, 1000)})


@query("SELECT * FROM (SELECT 'orders' AS label, (SELECT count(*) FROM orders) AS n, 'ok' AS verdict UNION ALL SELECT 'part', (SELECT count(*) FROM part), 'extra' UNION ALL SELECT 'bill', 0, 'missing')")
def load_report(t: demo.Tables) -> DataFrame:
    counts = quality.count_labels({"orders": t.orders, "part": t.part})
    return quality.load_report(counts, t.orders.select(F.explode(F.array(F.lit("orders"), F.lit("bill"))).alias("label")).distinct())


def gold(t: demo.Tables) -> tuple[DataFrame, DataFrame]:
    """labels as gold rows: quality and toxicity decide the expectation, every third has no result under its id; a result row for each document."""
    g = t.labels.select(F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("id"), F.array(F.when(F.col("quality") == 1, "vote_cast").otherwise("office_held")).alias("expected_claim_types"), F.when(F.col("toxic") == 1, "non_checkable").otherwise("supported").alias("expected_verdict"), F.lit(None).cast("string").alias("expected_verdict_live"))
    r = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "vote_cast").otherwise("office_held").alias("claim_type"), F.when(F.col("doc_id") % 5 == 0, "non_checkable").otherwise("supported").alias("status"), (F.col("doc_id") % 4).cast("long").alias("n_evidence"))
    return g, r


ROWS = """
r AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'vote_cast' ELSE 'office_held' END AS t, CASE WHEN doc_id % 5 = 0 THEN 'non_checkable' ELSE 'supported' END AS s, doc_id % 4 AS n FROM documents),
m AS (SELECT g.doc_id AS id, CASE WHEN r.id IS NULL THEN 0.0 WHEN r.t = CASE WHEN quality = 1 THEN 'vote_cast' ELSE 'office_held' END THEN 1.0 ELSE 0.0 END AS p, r.id IS NOT NULL AS has, r.s, r.s = CASE WHEN toxic = 1 THEN 'non_checkable' ELSE 'supported' END AS vm, CASE WHEN r.s = 'supported' THEN r.n > 0 END AS prov FROM labels g LEFT JOIN r ON r.id = CASE WHEN g.doc_id % 3 = 0 THEN -g.doc_id - 1 ELSE g.doc_id END),
met AS (SELECT count(*)::DOUBLE AS rows, avg(p)::DOUBLE AS mean_claim_typing_precision, avg(p)::DOUBLE AS mean_claim_typing_recall, coalesce(avg(CASE WHEN p > 0 THEN p END), 0)::DOUBLE AS f1_claim_typing, coalesce(avg(vm::INT), 0)::DOUBLE AS f1_verdict,
  (count(*) FILTER (s = 'non_checkable') / count(s))::DOUBLE AS abstention_rate, coalesce(avg(prov::INT), 1)::DOUBLE AS provenance_completeness, coalesce(avg(CASE WHEN s = 'non_checkable' THEN vm::INT END), 1)::DOUBLE AS abstention_correctness FROM m)
"""


@query(f"WITH {ROWS} SELECT round(rows, 6) AS rows, round(mean_claim_typing_precision, 6) AS mean_claim_typing_precision, round(mean_claim_typing_recall, 6) AS mean_claim_typing_recall, round(f1_claim_typing, 6) AS f1_claim_typing, round(f1_verdict, 6) AS f1_verdict, round(abstention_rate, 6) AS abstention_rate, round(provenance_completeness, 6) AS provenance_completeness, round(abstention_correctness, 6) AS abstention_correctness FROM met")
def eval_metrics(t: demo.Tables) -> DataFrame:
    m = metrics.aggregate(metrics.row_metrics(*gold(t)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(f"WITH {ROWS} SELECT 'f1_verdict' AS gate, round(f1_verdict, 6) AS value, 1.0::DOUBLE AS least FROM met WHERE f1_verdict < 1.0 UNION ALL SELECT 'abstention_correctness', round(abstention_correctness, 6), 1.0 FROM met WHERE abstention_correctness < 1.0 UNION ALL SELECT 'f1_claim_typing', f1_claim_typing, 1.0 FROM met WHERE f1_claim_typing < 1.0 UNION ALL SELECT 'rows', rows, 25.0 FROM met WHERE rows < 25")
def gates(t: demo.Tables) -> DataFrame:
    m = metrics.aggregate(metrics.row_metrics(*gold(t)))
    return metrics.failed_gates(m).select("gate", F.round("value", 6).alias("value"), "least")


@query(
    """WITH runs AS (SELECT event_type AS f, user_id AS a, max(ts) AS last FROM events WHERE event_type <> 'error' GROUP BY ALL), mf AS (SELECT DISTINCT event_type AS f, user_id AS a FROM events)
    SELECT mf.f AS family, mf.a::VARCHAR AS adapter, CASE WHEN mf.a % 2 = 0 THEN 3600 ELSE 86400 END::INT AS interval_s, date_diff('second', date_trunc('second', last), TIMESTAMP '2024-01-31') AS age_s, coalesce(date_diff('second', date_trunc('second', last), TIMESTAMP '2024-01-31') > 2 * CASE WHEN mf.a % 2 = 0 THEN 3600 ELSE 86400 END, false) AS stale, CASE WHEN last IS NULL THEN 'never run' END AS note FROM mf LEFT JOIN runs USING (f, a)"""
)
def freshness(t: demo.Tables) -> DataFrame:
    e = t.events.withColumn("ts", F.date_trunc("second", F.col("ts")))
    manifests = e.select(F.col("event_type").alias("family"), demo.s("user_id").alias("adapter"), F.when(F.col("user_id") % 2 == 0, "7 * * * *").otherwise("7 3 * * *").alias("cadence_cron")).distinct()
    runs = e.select(F.col("event_type").alias("source_family"), demo.s("user_id").alias("adapter"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), F.col("ts").alias("finished_at"))
    return metrics.freshness(manifests, runs, F.lit("2024-01-31").cast("timestamp_ntz")).select("family", "adapter", "interval_s", "age_s", "stale", "note")


# ---------------------------------------------------------------- the whole check


def sentence_kb(t: demo.Tables) -> verify.KnowledgeBase:
    """Names of the sentences as entities: suppliers as persons, parts as bills (their repeated names are ambiguous)."""
    people = t.supplier.select(F.lit("person").alias("kind"), demo.s("s_suppkey").alias("entity_id"), demo.letters(F.col("s_name")).alias("canonical_name"))
    bills = t.part.select(F.lit("bill").alias("kind"), demo.s("p_partkey").alias("entity_id"), demo.letters(F.col("p_name")).alias("canonical_name"))
    e = people.unionByName(bills)
    entities = e.select("kind", "entity_id", "canonical_name", F.lit(None).cast("string").alias("hebrew_name"), F.col("canonical_name").alias("english_name"), F.create_map().cast("map<string,string>").alias("external_ids"))
    aliases = e.select(F.col("kind").alias("entity_kind"), F.lower("canonical_name").alias("alias_text"), F.lit("en").alias("alias_locale"), F.col("entity_id").alias("canonical_entity_id"), F.lit(100).alias("confidence"))
    sponsored = t.lineitem.groupBy(demo.s("l_suppkey").alias("person_id"), demo.s("l_partkey").alias("bill_id")).agg(F.min("l_shipdate").alias("sponsored_at"))
    return verify.KnowledgeBase({**t.vote_kb(), "sponsored": sponsored}, entities, aliases, fuzzy=False)


NAMES_OF = "lower(translate(regexp_replace({}, '[#_]', '', 'g'), '0123456789', 'abcdefghij'))"
CHECKED = f"""{_claims_sql()},
    pe AS (SELECT {NAMES_OF.format('s_name')} AS n, count(*) AS k, min(s_suppkey) AS id FROM supplier GROUP BY 1), bi AS (SELECT {NAMES_OF.format('p_name')} AS n, count(*) AS k, min(p_partkey) AS id FROM part GROUP BY 1),
    c AS (SELECT cl.id, claim_type, vote, CASE WHEN pe.k = 1 AND bi.k = 1 THEN CASE WHEN claim_type = 'vote_cast' AND time_phrase IS NULL THEN 'insufficient_time_scope' ELSE 'checkable' END ELSE 'insufficient_entity_resolution' END AS chk,
      pe.id AS p, bi.id AS b, CASE WHEN time_phrase = 'last term' THEN TIMESTAMP '2020-12-22' WHEN time_phrase LIKE '%18th%' THEN TIMESTAMP '2009-02-24' ELSE make_date(try_cast(time_phrase AS INT), 1, 1)::TIMESTAMP END AS ts,
      CASE WHEN time_phrase = 'last term' THEN TIMESTAMP '2022-11-15 23:59:59' WHEN time_phrase LIKE '%18th%' THEN TIMESTAMP '2013-02-05 23:59:59' ELSE make_date(try_cast(time_phrase AS INT), 12, 31)::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 SECOND END AS te
      FROM cl LEFT JOIN pe ON pe.n = lower(speaker) LEFT JOIN bi ON bi.n = lower(bill)),
    v AS (SELECT l_suppkey AS p, l_partkey AS b, l_orderkey || '-' || l_suppkey || '-' || l_partkey || '-' || l_linenumber || '-' || strftime(l_shipdate, '%Y%m%d') AS ev, CASE l_returnflag WHEN 'A' THEN 'for' WHEN 'R' THEN 'against' ELSE 'abstain' END AS value, l_shipdate AS tm, l_linenumber AS doc FROM lineitem),
    f AS (SELECT c.id, v.value, v.doc, row_number() OVER (PARTITION BY c.id ORDER BY v.tm DESC, v.ev) AS rn FROM c JOIN v USING (p, b) WHERE chk = 'checkable' AND claim_type = 'vote_cast' AND tm >= ts AND tm <= te),
    fa AS (SELECT id, count(*) AS n, count(DISTINCT doc) AS docs, list_sort(list(DISTINCT value)) AS vals FROM f WHERE rn <= 10 GROUP BY id),
    sp AS (SELECT DISTINCT p, b, 1 AS one FROM v),
    j AS (SELECT c.*, CASE WHEN chk <> 'checkable' THEN 0 WHEN claim_type = 'vote_cast' THEN coalesce(fa.n, 0) ELSE coalesce(sp.one, 0) END AS n, vals,
      CASE WHEN claim_type = 'vote_cast' THEN 0.9 + 0.1 * CASE WHEN docs <= 1 THEN 0.3 WHEN docs = 2 THEN 0.7 ELSE 1.0 END ELSE 0.85 END AS o FROM c LEFT JOIN fa USING (id) LEFT JOIN sp ON sp.p = c.p AND sp.b = c.b),
    bundle AS (SELECT id AS statement_id, claim_type, chk AS checkability, n, round(CASE WHEN n > 0 THEN o ELSE 0 END, 4)::DOUBLE AS overall,
      CASE WHEN chk <> 'checkable' THEN 'non_checkable' WHEN n = 0 THEN 'insufficient_evidence' WHEN claim_type = 'bill_sponsorship' THEN 'supported' WHEN vals = [vote] THEN 'supported' WHEN list_contains(vals, vote) THEN 'mixed' ELSE 'contradicted' END AS status FROM j)"""


@query(
    f"""WITH {CHECKED} SELECT statement_id, claim_type, checkability, status, overall, n::BIGINT AS n_evidence, least(n, 5)::INT AS n_top,
    CASE WHEN checkability <> 'checkable' THEN checkability = 'insufficient_entity_resolution' WHEN n = 0 THEN true ELSE overall < 0.62 OR status = 'mixed' END AS needs_human_review FROM bundle"""
)
def statement_check(t: demo.Tables) -> DataFrame:
    """Statements -> claims -> resolved ids -> facts -> ranking -> verdicts with their top evidence, compared as a whole."""
    b = verify.verify(t.sentences(), sentence_kb(t), F.to_date(F.lit("2024-06-01")))
    return b.select("statement_id", "claim_type", "checkability", "status", F.col("confidence.overall").alias("overall"), "n_evidence", F.size("top_evidence").alias("n_top"), "needs_human_review")


RELATION_OF = """CASE status WHEN 'supported' THEN 'supported_by' WHEN 'contradicted' THEN 'contradicted_by' WHEN 'mixed' THEN 'overstates' WHEN 'insufficient_evidence' THEN 'not_checkable_against_record'
    ELSE CASE checkability WHEN 'insufficient_entity_resolution' THEN 'entity_ambiguous' WHEN 'insufficient_time_scope' THEN 'time_scope_mismatch' ELSE 'not_checkable_against_record' END END"""


@query(
    f"""WITH {CHECKED} SELECT sen.id AS declaration_id, CASE WHEN claim_type IS NULL THEN 'unknown' ELSE 'formal_action' END AS claim_family, CASE WHEN claim_type IS NULL THEN 'not_checkable' WHEN checkability = 'checkable' THEN 'checkable_formal_action' ELSE checkability END AS checkability,
    CASE WHEN claim_type IS NULL THEN 'not_checkable_against_record' ELSE {RELATION_OF} END AS overall_relation FROM sen LEFT JOIN bundle ON statement_id = sen.id"""
)
def declaration_attribution(t: demo.Tables) -> DataFrame:
    u = t.sentences().withColumnRenamed("statement_id", "declaration_id")
    d, _, _ = verify.verify_declarations(u, sentence_kb(t), F.to_date(F.lit("2024-06-01")))
    return d.select("declaration_id", "claim_family", "checkability", "overall_relation")
