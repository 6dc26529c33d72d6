"""More registered queries: adapters and landed files, all extraction rules, the resolution ladder, ranking axes, review, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import timescope
from .functions.keys import uuid5
from .operators import adapters, attribution, extract, lexical, quality, rank, resolve, review, upsert
from .operators.retrieve import top_k
from .plans import demo
from .plans.materialise import shared_folder
from .queries import ACTIONS, CALENDAR, TOKENS, day, query, review_tables, uuid_sql
from .sources import archive, readers
from .streaming import jobs

# ---------------------------------------------------------------- adapters and landed files


NAME_SQL = "trim(regexp_replace('  ' || s_name || ' ' || coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN 'of  ' || s_nationkey END, ''), '\\s+', ' ', 'g'))"


@query(
    f"""SELECT {uuid_sql("'knesset_person:' || s_suppkey")} AS person_id, CASE WHEN s_suppkey % 11 = 0 THEN 'person:' || s_suppkey ELSE {NAME_SQL} END AS canonical_name, CASE WHEN s_suppkey % 11 <> 0 THEN {NAME_SQL} END AS hebrew_name,
    s_suppkey % 2 = 0 AS is_current FROM supplier WHERE s_suppkey % 7 <> 0"""
)
def people_normalise(t: demo.Tables) -> DataFrame:
    k = F.col("s_suppkey")
    raw = t.supplier.select(F.when(k % 7 != 0, k).alias("PersonID"), F.when(k % 11 != 0, F.concat(F.lit("  "), "s_name")).alias("FirstName"), F.when((k % 11 != 0) & (k % 3 != 0), F.concat(F.lit("of  "), demo.s("s_nationkey"))).alias("LastName"), F.when(k % 2 == 0, True).alias("IsCurrent"))
    return adapters.people(raw).select("person_id", "canonical_name", "hebrew_name", "is_current")


@query(f"SELECT {uuid_sql("'knesset_committee:' || p_partkey")} AS committee_id, CASE WHEN p_partkey % 5 = 0 THEN 'committee:' || p_partkey ELSE p_name END AS canonical_name, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS hebrew_name FROM part WHERE p_partkey % 9 <> 0")
def committees_normalise(t: demo.Tables) -> DataFrame:
    k = F.col("p_partkey")
    return adapters.committees(t.part.select(F.when(k % 9 != 0, k).otherwise(0).alias("CommitteeID"), F.when(k % 5 != 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise(" ").alias("Name")))


@query(
    f"""SELECT {uuid_sql("'knesset_person:' || (o_custkey * 10)")} AS person_id, {uuid_sql("'knesset_committee:' || (o_orderkey % 40)")} AS committee_id, o_orderdate::DATE::VARCHAR AS valid_from, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE::VARCHAR END AS valid_to,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 20 + o_orderkey % 4 END::INT AS knesset_number, count(*) AS n FROM orders WHERE o_orderkey % 40 <> 0 AND o_custkey % 6 <> 0 AND o_orderkey % 13 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY ALL"""
)
def memberships_normalise(t: demo.Tables) -> DataFrame:
    """Members that the lookup does not know, and rows without a start, drop out."""
    k = F.col("o_orderkey")
    raw = t.orders.select(
        F.concat(F.lit(" "), demo.s("o_custkey")).alias("mk_individual_id"), (k % 40).cast("string").alias("committee_id"), F.lit("c").alias("committee_name"), F.when(k % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(" ").alias("start_date"),
        F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("finish_date"), F.when(k % 4 == 0, "none").otherwise((k % 4 + 20).cast("string")).alias("knesset"),
    )
    members = t.customer.select(demo.s("c_custkey").alias("mk_individual_id"), F.when(F.col("c_custkey") % 6 != 0, (F.col("c_custkey") * 10).cast("string")).alias("PersonID"), F.lit(1).alias("seq"))
    lookup = readers.load_lookup(members, "mk_individual_id", "PersonID", F.col("seq"))
    m = adapters.committee_memberships(raw, lookup).select("person_id", "committee_id", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"), "knesset_number")
    return m.groupBy(*m.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {uuid_sql("'knesset_bill:' || p_partkey")} AS bill_id, CASE WHEN p_partkey % 4 = 0 THEN 'bill:' || p_partkey ELSE p_name END AS title, p_size::INT AS knesset_number, CASE WHEN p_partkey % 3 <> 0 THEN 'status:' || (p_partkey % 3) END AS status FROM part WHERE p_partkey <> 0")
def bills_normalise(t: demo.Tables) -> DataFrame:
    k = F.col("p_partkey")
    return adapters.bills(t.part.select(k.alias("BillID"), F.when(k % 4 != 0, F.col("p_name")).alias("Name"), F.col("p_size").alias("KnessetNum"), (k % 3).alias("StatusID")))


@query(f"SELECT {uuid_sql("'knesset_person:' || l_suppkey")} AS person_id, {uuid_sql("'knesset_bill:' || l_partkey")} AS bill_id, l_linenumber::INT AS ordinal, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey % 10 <> 0 AND l_suppkey <> 0 AND l_partkey <> 0 GROUP BY l_suppkey, l_partkey, l_linenumber")
def initiators_normalise(t: demo.Tables) -> DataFrame:
    raw = t.lineitem.select((F.col("l_orderkey") % 10).alias("BillInitiatorID"), F.col("l_partkey").alias("BillID"), F.col("l_suppkey").alias("PersonID"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("IsInitiator"), F.col("l_linenumber").alias("Ordinal"))
    return adapters.bill_initiators(raw).groupBy("person_id", "bill_id", "ordinal").agg(F.count(F.lit(1)).alias("n"))


def landed(rows: DataFrame, page: Column, item: Column, wrap) -> str:
    """Rows as pages of a public service: one JSON document a file, one file a page (pages hold a bounded number of rows)."""
    path = shared_folder(rows.sparkSession, "landed")
    pages = rows.select(page.alias("page"), item.alias("i")).groupBy("page").agg(F.collect_list("i").alias("rows"))
    pages.select("page", F.to_json(wrap(F.col("rows"))).alias("value")).write.partitionBy("page").text(path)
    return path


@query(
    f"""SELECT {uuid_sql("'budgetkey_gov_decision:' || o_orderkey")} AS government_decision_id, o_custkey::VARCHAR AS decision_number, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 40 END::INT AS government_number, o_orderdate::DATE::VARCHAR AS decision_date,
    o_orderpriority AS title, CASE WHEN o_orderkey % 5 <> 0 THEN '{adapters.DECISION_URL}' || o_orderkey END AS source_url FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 17 <> 0"""
)
def decisions_normalise(t: demo.Tables) -> DataFrame:
    """Search pages landed as JSON, read as decision rows and normalised."""
    k = F.col("o_orderkey")
    hit = F.struct(
        demo.s("o_orderkey").alias("id"), demo.s("o_custkey").alias("procedure_number_str"), F.when(k % 3 == 0, "x").otherwise(F.concat(F.lit("הממשלה ה- "), (k % 40).cast("string"))).alias("government"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publish_date"),
        F.when(k % 17 != 0, F.col("o_orderpriority")).otherwise(" ").alias("title"), F.lit("t").alias("text"), F.lit("o").alias("office"), F.when(k % 5 != 0, demo.s("o_orderkey")).otherwise("").alias("url_id"), F.when(F.col("o_orderstatus") != "P", readers.DECISIONS).otherwise("x").alias("policy_type"),
    )
    wrap = lambda r: F.struct(F.struct(F.struct(F.size(r).alias("total_overall")).alias("_current")).alias("search_counts"), F.transform(r, lambda x: F.struct(x.alias("source"))).alias("search_results"))
    d = adapters.government_decisions(readers.read_search_hits(t.spark, landed(t.orders, F.floor(k / 2000), hit, wrap)))
    return d.select("government_decision_id", "decision_number", "government_number", day("decision_date").alias("decision_date"), "title", "source_url")


@query("SELECT o_orderkey AS id, o_custkey AS customer, (o_orderkey // 2000)::VARCHAR AS next_link, count(*) OVER (PARTITION BY o_orderkey // 2000)::VARCHAR AS page_count FROM orders")
def paged_json(t: demo.Tables) -> DataFrame:
    """Rows of landed pages, half of them in the other key style."""
    k = F.col("o_orderkey")
    styles = [landed(t.orders.withColumn("p", F.floor(k / 2000)).where(F.col("p") % 2 == i), F.col("p"), F.struct(k.alias("id"), F.col("o_custkey").alias("customer"), F.col("p")), lambda r, s=s: F.struct(r.alias("value"), r[0].p.cast("string").alias(f"{s}odata.nextLink"), F.size(r).cast("string").alias(f"{s}odata.count"))) for i, s in enumerate(("", "@"))]
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("customer", T.LongType())])
    parts = [readers.read_paged_json(t.spark, path, row)[0].select("id", "customer", "next_link", "page_count") for path in styles]
    return parts[0].unionByName(parts[1])


@query("SELECT doc_id::VARCHAR AS doc_id, nullif(text, '') AS text FROM documents")
def csv_dump(t: demo.Tables) -> DataFrame:
    """A dump with quotes, commas and line ends inside cells, read back as strings."""
    path = shared_folder(t.spark, "dump")
    t.documents.select("doc_id", "text").write.option("header", True).option("escape", '"').option("quoteAll", True).option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv_dump(t.spark, path).select("doc_id", "text")


@query("SELECT s_suppkey::VARCHAR AS adapter, s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AS valid FROM supplier")
def manifests(t: demo.Tables) -> DataFrame:
    k, path = F.col("s_suppkey"), shared_folder(t.spark, "manifests")
    t.supplier.select(
        F.lit("f").alias("family"), demo.s("s_suppkey").alias("adapter"), F.when(k % 5 == 0, "ftp://x").otherwise("https://x").alias("source_url"), (k % 4).cast("int").alias("source_tier"), F.lit("p").alias("parser"), F.lit("* * * * *").alias("cadence_cron"), F.create_map(F.lit("k"), F.lit("v")).alias("entity_hints")
    ).write.json(path)
    ok, bad = readers.read_manifests(t.spark, path)
    return ok.select("adapter", F.lit(True).alias("valid")).unionByName(bad.select("adapter", F.lit(False).alias("valid")))


@query("WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS s, CASE WHEN doc_id % 3 <> 0 THEN 'the' END AS a FROM documents) SELECT doc_id, trim(coalesce(list_filter(s, lambda x: contains(x, a))[1], text), ' ') AS excerpt FROM l")
def excerpts(t: demo.Tables) -> DataFrame:
    return t.documents.select("doc_id", readers.select_excerpt(F.col("text"), F.when(F.col("doc_id") % 3 != 0, "the")).alias("excerpt"))


@query("SELECT s_suppkey::VARCHAR AS statement_id, (s_suppkey % 3)::VARCHAR AS claim_id, CASE WHEN s_suppkey % 4 = 0 THEN 'non_checkable' ELSE 'checkable' END AS checkability FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 3 <> 1")
def statement_sink(t: demo.Tables) -> DataFrame:
    """Claims that the sink does not hold yet; even suppliers' claim 1 is there already."""
    k = F.col("s_suppkey")
    statements = t.supplier.select(demo.s("s_suppkey").alias("statement_id"), F.col("s_name").alias("text"))
    claims = t.supplier.select(demo.s("s_suppkey").alias("statement_id"), (k % 3).cast("string").alias("claim_id"), F.when(k % 4 != 0, "checkable").alias("checkability"))
    held = t.supplier.select(F.when(k % 2 == 0, demo.s("s_suppkey")).otherwise("none").alias("statement_id"), F.lit("1").alias("claim_id"))
    _, rows = archive.write_statements(statements.unionByName(statements), claims.unionByName(claims), held.select("statement_id").where("statement_id = 'none'"), held)
    return rows


@query("WITH a AS (SELECT count(*) AS n, count(DISTINCT sha256(text)) AS h FROM documents WHERE text IS NOT NULL) SELECT 'pages' AS stat, n AS value FROM a UNION ALL SELECT 'archived', h FROM a UNION ALL SELECT 'parsed', n FROM a UNION ALL SELECT 'upserted', n FROM a")
def adapter_run(t: demo.Tables) -> DataFrame:
    """One adapter run: pages archived by content, parsed, normalised, upserted; its counters."""
    pages = t.documents.where("text IS NOT NULL").select(
        demo.s("doc_id").alias("key"), F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("content_type"), F.lit("statements").alias("family"), F.col("source").alias("source_url"), F.lit("2024-02-03 01:02:03").cast("timestamp").alias("captured_at"), F.lit(2).alias("source_tier"), F.col("doc_id").alias("seq")
    )
    empty = t.spark.createDataFrame([], "content_sha256 string, archive_uri string")
    run = upsert.run_adapter(pages, lambda p: p.select("key", "source_url", "seq"), lambda r: r, pages.select("key", "source_url").limit(0), "key", archived=empty)
    return run.counts


# ---------------------------------------------------------------- all rules of extraction


#: A sentence for each rule that is anchored at its end, from a name and a number.
SENTENCES = {
    "R1": "{p} הצביע בעד חוק {b} ב{y}.", "R2": "{p} הגיש את הצעת חוק {b} ב{y}", "R3": "{p} כיהן כשר החינוך ב{y}", "R4": "{p} היה חבר בועדת {b}", "R5": "{p} השתתף בועדת {b} ב{y}!", "R6": "{p} voted against the {b} bill in {y}.", "R7": "{p} introduced the {b} bill",
    "R8": "{p} served as Minister of Health in {y}", "R9": "{p} sat on the {b} committee", "R10": "{p} attended a session of the {b} committee in {y}?", "R11": "מפלגת {b} זכתה {n} מנדטים ב{y}", "R12": "מפלגת {b} לא עברה את אחוז החסימה", "R13": "The {b} list won {n} seats in {y}", "R14": "The {b} list did not pass the electoral threshold",
}
_LANG = {r.name: r.language for r in extract.RULES}


def rule_sentences(t: demo.Tables) -> DataFrame:
    k = F.col("o_orderkey")
    part = {"{p}": F.concat(F.lit("Dan "), demo.letters(demo.s("o_custkey"))), "{b}": demo.letters((k % 997).cast("string")), "{y}": F.year("o_orderdate").cast("string"), "{n}": (k % 120 + 1).cast("string")}
    said, lang = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, pattern) in enumerate(SENTENCES.items()):
        s = F.lit(pattern)
        for key, value in part.items():
            s = F.replace(s, F.lit(key), value)
        said, lang = F.when(k % len(SENTENCES) == i, s).otherwise(said), F.when(k % len(SENTENCES) == i, _LANG[name]).otherwise(lang)
    return t.orders.select(demo.s("o_orderkey").alias("statement_id"), said.alias("text"), lang.alias("language"))


def _rules_sql() -> str:
    lettered = "translate({}, '0123456789', 'abcdefghij')"
    part = {"{p}": f"'Dan ' || {lettered.format('o_custkey::VARCHAR')}", "{b}": lettered.format("(o_orderkey % 997)::VARCHAR"), "{y}": "year(o_orderdate)::VARCHAR", "{n}": "(o_orderkey % 120 + 1)::VARCHAR"}
    cases = []
    for i, pattern in enumerate(SENTENCES.values()):
        s = f"'{pattern}'"
        for key, value in part.items():
            s = f"replace({s}, '{key}', {value})"
        cases.append(f"WHEN {i} THEN {s}")
    sen = f"sen AS (SELECT o_orderkey::VARCHAR AS statement_id, o_orderkey % {len(SENTENCES)} AS r, CASE o_orderkey % {len(SENTENCES)} {' '.join(cases)} END AS text FROM orders)"
    slots = {"speaker_person_id": "subject", "bill_id": "bill", "office_id": "office", "committee_id": "committee", "party_id": "party", "expected_seats": "seats", "time_phrase": "time"}
    parts = []
    for i, name in enumerate(SENTENCES):
        r = next(x for x in extract.RULES if x.name == name)
        pattern = r.re2().replace("'", "''")
        cols = [f"nullif(trim(regexp_extract(text, '{pattern}', {r.groups.index(g) + 1})), '') AS {c}" if g in r.groups else f"NULL::VARCHAR AS {c}" for c, g in slots.items()]
        vote = "CASE WHEN r = 0 THEN 'for' WHEN r = 5 THEN 'against' END AS vote_value" if "vote_value" in r.groups else "NULL::VARCHAR AS vote_value"
        parts.append(f"SELECT statement_id, '{r.claim_type}' AS claim_type, {', '.join(cols)}, {vote}, {"'false'" if r.below else 'NULL::VARCHAR'} AS expect_passed_threshold FROM sen WHERE r = {i} AND regexp_matches(text, '{pattern}')")
    return f"WITH {sen} {' UNION ALL '.join(parts)}"


@query(_rules_sql())
def extract_rules(t: demo.Tables) -> DataFrame:
    """One sentence an order, for each of the fourteen anchored rules in both languages, with all slots."""
    claims, _ = extract.extract(rule_sentences(t), F.to_date(F.lit("2024-06-01")))
    return claims.select("statement_id", "claim_type", "speaker_person_id", "bill_id", "office_id", "committee_id", "party_id", "expected_seats", "time_phrase", "vote_value", "expect_passed_threshold")


@query(
    f"""WITH {CALENDAR}, p AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, month(o_orderdate) AS m, year(o_orderdate) AS y, o_orderkey % 30 AS n FROM orders)
    SELECT k, CASE k % 3 WHEN 0 THEN make_date(y, m, 1) WHEN 1 THEN c.s ELSE make_date(year(d) - 1, 1, 1) END::VARCHAR AS first_day, CASE k % 3 WHEN 0 THEN last_day(make_date(y, m, 1)) WHEN 1 THEN c.e ELSE make_date(year(d) - 1, 12, 31) END::VARCHAR AS last_day,
      CASE k % 3 WHEN 0 THEN 'month' WHEN 1 THEN CASE WHEN c.n IS NULL THEN 'unknown' ELSE 'term' END ELSE 'year' END AS granularity FROM p LEFT JOIN cal c ON c.n = p.n"""
)
def time_scopes_hebrew(t: demo.Tables) -> DataFrame:
    """Months, terms and last year in Hebrew."""
    k = F.col("o_orderkey")
    month = F.get(F.array(*[F.lit(m) for m in timescope.MONTHS]), F.month("o_orderdate") - 1)
    phrase = F.when(k % 3 == 0, F.concat(F.lit("ב"), month, F.lit(" "), F.year("o_orderdate").cast("string"))).when(k % 3 == 1, F.concat(F.lit("בכנסת ה-"), (k % 30).cast("string"))).otherwise("בשנה שעברה")
    d = t.orders.select(k.alias("k"), timescope.normalize_time_scope(phrase, F.to_date("o_orderdate")).alias("x"))
    return d.select("k", day("x.start").alias("first_day"), day("x.end").alias("last_day"), F.col("x.granularity").alias("granularity"))


# ---------------------------------------------------------------- resolution


def ladder_tables(t: demo.Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as persons with a Hebrew and an English name, an id and an alias; customers mention them in six ways."""
    k = F.col("s_suppkey")
    he = F.concat(F.lit("דן "), demo.s("s_suppkey"))
    entities = t.supplier.select(F.lit("person").alias("kind"), demo.s("s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"), he.alias("hebrew_name"), F.col("s_name").alias("english_name"), F.create_map(F.lit("tax"), F.concat(F.lit("T"), demo.s("s_suppkey"))).alias("external_ids"))
    alias = lambda text, locale, shift, n: t.supplier.select(F.lit("person").alias("entity_kind"), text.alias("alias_text"), F.lit(locale).alias("alias_locale"), (k + shift).cast("string").alias("canonical_entity_id"), F.lit(n).alias("confidence"))
    aliases = alias(F.concat(F.lit("כינוי "), demo.s("s_suppkey")), "he", 0, 90).unionByName(alias(F.concat(F.lit("nick "), demo.s("s_suppkey")), "en", 0, 80)).unionByName(alias(F.concat(F.lit("nick "), demo.s("s_suppkey")), "en", 1, 80)).unionByName(alias(F.concat(F.lit("dn x"), demo.s("s_suppkey")), "en", 0, 70))
    c, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    way = c % 6
    none = F.lit(None).cast("string")
    mentions = t.customer.select(
        demo.s("c_custkey").alias("mention_id"), F.lit("person").alias("kind"), F.when(way == 1, F.concat(F.lit("  דן "), n)).when(way == 2, F.concat(F.lit("כינוי "), n)).when(way == 4, F.concat(F.lit("דן x"), n)).otherwise(none).alias("hebrew_name"),
        F.when(way == 3, F.concat(F.lit(" NICK "), n)).when(way == 0, F.concat(F.lit("nick "), n)).when(way == 5, F.lit("nobody")).otherwise(none).alias("english_name"),
        F.when(way == 0, F.array(F.struct(F.lit("none").alias("scheme"), F.lit("x").alias("value")), F.struct(F.lit("tax").alias("scheme"), F.concat(F.lit("T"), n).alias("value")))).alias("external_ids"),
    )
    return mentions, entities, aliases


LADDER = """m AS (SELECT c_custkey AS k, c_custkey % 6 AS way, c_nationkey AS n FROM customer), s AS (SELECT s_suppkey AS e FROM supplier),
hit AS (SELECT k, e, CASE way WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 4 END AS step, CASE way WHEN 0 THEN 100 WHEN 1 THEN 95 WHEN 2 THEN 90 WHEN 3 THEN 80 ELSE 60 END AS score FROM m JOIN s ON e = n WHERE way < 5 UNION ALL SELECT k, e + 1, 3, 80 FROM m JOIN s ON e = n WHERE way = 3)"""


@query(f"WITH {LADDER} SELECT k::VARCHAR AS mention_id, e::VARCHAR AS entity_id, step::INT AS step, score::INT AS score FROM hit")
def resolve_ladder(t: demo.Tables) -> DataFrame:
    """External id, Hebrew name, Hebrew and English alias, transliteration: the first step that has a candidate."""
    return resolve.ladder(*ladder_tables(t), fuzzy=False).select("mention_id", "entity_id", "step", "score")


@query(f"WITH {LADDER} SELECT k::VARCHAR AS mention_id, CASE count(e) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(e) = 1 THEN min(e)::VARCHAR END AS entity_id FROM m LEFT JOIN hit USING (k) GROUP BY k")
def resolve_all(t: demo.Tables) -> DataFrame:
    mentions, entities, aliases = ladder_tables(t)
    return resolve.resolve(mentions, entities, aliases, fuzzy=False)[0].select("mention_id", "status", "entity_id")


@query(f"WITH {LADDER}, a AS (SELECT k FROM hit GROUP BY k HAVING count(*) > 1) SELECT e::VARCHAR AS canonical_entity_id, (score / 100.0)::DOUBLE AS confidence, ' NICK ' || n AS mention_text, count(*) AS n FROM hit JOIN a USING (k) JOIN m USING (k) GROUP BY ALL")
def candidate_rows(t: demo.Tables) -> DataFrame:
    """Rows of the candidate table for ambiguous mentions."""
    mentions, entities, aliases = ladder_tables(t)
    rows = resolve.ambiguous_rows(mentions, *resolve.resolve(mentions, entities, aliases, fuzzy=False))
    return rows.groupBy("canonical_entity_id", "confidence", "mention_text").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS er FROM orders), a AS (SELECT l_orderkey AS id, arg_max(l_suppkey, l_suppkey * 100000 + l_partkey) AS new FROM lineitem WHERE l_partkey % 4 = 0 AND l_linenumber <> 7 GROUP BY 1)
    SELECT 'c' || t.id AS candidate_id, CASE WHEN er AND new IS NOT NULL THEN new::VARCHAR ELSE 'old' END AS canonical_entity_id FROM t LEFT JOIN a USING (id)"""
)
def relink_candidates(t: demo.Tables) -> DataFrame:
    """Order lines as reviewers' actions on candidate rows: the last relink of a known kind wins."""
    k = F.col("o_orderkey")
    ident = F.concat(F.lit("c"), demo.s("o_orderkey"))
    candidates = t.orders.select(ident.alias("candidate_id"), F.lit("old").alias("canonical_entity_id"), F.lit("person").alias("entity_kind"))
    tasks = t.orders.select(demo.s("o_orderkey").alias("task_id"), F.when(k % 3 == 0, "entity_resolution").otherwise("verdict").alias("kind"), F.to_json(F.struct(ident.alias("candidate_id"))).alias("payload"))
    actions = t.lineitem.select(
        demo.s("l_orderkey").alias("task_id"), F.when(F.col("l_partkey") % 4 == 0, "relink").otherwise("annotate").alias("action"), F.concat(F.lit("c"), demo.s("l_orderkey")).alias("candidate_id"), demo.s("l_suppkey").alias("new_entity_id"),
        F.when(F.col("l_linenumber") == 7, "planet").otherwise("person").alias("entity_kind"), (F.col("l_suppkey") * 100000 + F.col("l_partkey")).alias("action_seq"),
    )
    return resolve.relink(candidates, tasks, actions).select("candidate_id", "canonical_entity_id")


# ---------------------------------------------------------------- ranking on all axes


AXES_SQL = """
e AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_suppkey AS s, l_partkey AS b, l_linenumber % 3 <> 0 AS fact, l_partkey % 4 + 1 AS tier, l_suppkey % 2 = 0 AS own, CASE WHEN l_partkey % 5 <> 0 THEN l_shipdate END AS occ, 'doc' || (l_suppkey % 3) AS doc,
  CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'short' ELSE repeat('x', 200) END AS txt FROM lineitem),
c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS ts, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 60 DAY END AS te, o_orderkey % 7 <> 0 AS scoped, CASE WHEN o_orderkey % 5 <> 0 THEN m.s END AS rs, CASE WHEN o_orderkey % 5 <> 0 THEN m.p END AS rb
  FROM orders JOIN (SELECT l_orderkey AS lk, min(struct_pack(s := l_suppkey, p := l_partkey)) AS m FROM lineitem GROUP BY 1) ON lk = o_orderkey),
d AS (SELECT k, count(DISTINCT doc) AS docs FROM e GROUP BY k),
x AS (SELECT e.k, ln, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 ELSE 0.1 END AS a1, CASE WHEN fact THEN CASE WHEN own THEN 1.0 ELSE 0.6 END WHEN txt = '' THEN 0.0 WHEN length(txt) < 160 THEN 0.75 ELSE 0.5 END AS a2,
  CASE WHEN NOT scoped THEN 0.5 WHEN fact THEN CASE WHEN occ IS NULL THEN 0.6 WHEN coalesce(occ < ts, false) OR coalesce(occ > te, false) THEN 0.2 ELSE 1.0 END ELSE CASE WHEN occ IS NULL THEN 0.5 WHEN coalesce(occ < ts, false) OR coalesce(occ > te, false) THEN 0.4 ELSE 0.8 END END AS a3,
  CASE WHEN rs IS NULL THEN 0.5 WHEN NOT fact THEN 0.6 WHEN (s = rs)::INT + (b = rb)::INT = 0 THEN 0.2 ELSE least(1.0, 0.5 + 0.25 * ((s = rs)::INT + (b = rb)::INT)) END AS a4, CASE WHEN docs <= 1 THEN 0.3 WHEN docs = 2 THEN 0.7 ELSE 1.0 END AS a5 FROM e JOIN c USING (k) JOIN d USING (k))
"""


@query(f"WITH {AXES_SQL} SELECT k::VARCHAR AS claim_id, ln::VARCHAR AS line, a1::DOUBLE AS source_tier_score, a2::DOUBLE AS directness, a3::DOUBLE AS temporal_alignment, a4::DOUBLE AS entity_resolution, a5::DOUBLE AS cross_source_consistency, count(*) AS n FROM x GROUP BY ALL")
def rank_axes(t: demo.Tables) -> DataFrame:
    """All axes over evidence of every tier, kind, type, date and id: lines as evidence of their order's claim."""
    supp, part = demo.s("l_suppkey"), demo.s("l_partkey")
    fact = F.col("l_linenumber") % 3 != 0
    at = F.when(F.col("l_partkey") % 5 != 0, F.col("l_shipdate"))
    e = t.lineitem.select(
        demo.s("l_orderkey").alias("claim_id"), F.when(fact, "fact").otherwise("text").alias("kind"), F.when(F.col("l_suppkey") % 2 == 0, "vote_cast").otherwise("office_held").alias("evidence_type"), F.create_map(F.lit("speaker_person_id"), supp, F.lit("bill_id"), part).alias("node_ids"),
        (F.col("l_partkey") % 4 + 1).alias("source_tier"), at.alias("occurred_at"), at.alias("captured_at"), F.array(F.concat(F.lit("doc"), (F.col("l_suppkey") % 3).cast("string"))).alias("source_document_ids"),
        demo.pick(F.col("l_suppkey") % 3, "", "short", "x" * 200).alias("text"), demo.s("l_linenumber").alias("span_id"),
    )
    k = F.col("o_orderkey")
    known = k % 5 != 0
    claims = t.order_pairs().select(
        demo.s("o_orderkey").alias("claim_id"), F.lit("vote_cast").alias("claim_type"), F.when(k % 3 != 0, F.col("o_orderdate")).alias("time_start"), F.when(k % 4 != 0, F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("time_end"), (k % 7 != 0).alias("has_scope"),
        F.when(known, F.create_map(F.lit("speaker_person_id"), supp, F.lit("bill_id"), part)).alias("resolved_ids"),
    )
    r = rank.score(e, claims).select("claim_id", F.col("span_id").alias("line"), *rank.AXES)
    return r.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH i AS (SELECT conv_id || '-' || turn AS id, role AS tag, {TOKENS.format("coalesce(text, '')")} AS t, {TOKENS.format("coalesce(role, '')")} AS g FROM conversations WHERE role IN ('user', 'assistant')),
    q AS (SELECT item_id AS q, unnest({TOKENS.format("text || ' user'")}) AS tok FROM benchmark),
    f AS (SELECT id, 2.0 AS boost, t AS w FROM i UNION ALL SELECT id, 1.0, g FROM i), st AS (SELECT boost, count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM f GROUP BY boost),
    tf AS (SELECT boost, id, dl, tok, count(*) AS tf FROM (SELECT boost, id, len(w) AS dl, unnest(w) AS tok FROM f) GROUP BY ALL), df AS (SELECT boost, tok, count(*) AS df FROM tf GROUP BY ALL),
    s AS (SELECT boost, q, id, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM q JOIN tf USING (tok) JOIN df USING (boost, tok) JOIN st USING (boost) GROUP BY ALL),
    b AS (SELECT q, id, round(max(s), 6) AS score FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rk FROM b) SELECT q AS query_id, id AS span_id, score::DOUBLE AS score FROM r WHERE rk <= 5"""
)
def search_fields(t: demo.Tables) -> DataFrame:
    """Best of two fields, each with its own statistics, over turns of two roles."""
    spans = t.conversations.where(F.col("role").isin("user", "assistant")).select(F.concat_ws("-", demo.s("conv_id"), demo.s("turn")).alias("span_id"), "text", F.col("role").alias("tag"))
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" user")).alias("query"))
    asked = lexical.best_of(queries, spans, {"text": 2.0, "tag": 1.0}).withColumn("score", F.round("score", 6))
    return top_k(asked, ["query_id"], [F.col("score").desc(), F.col("span_id")], 5).select("query_id", "span_id", "score")


# ---------------------------------------------------------------- attribution, review, quality


@query(
    f"""WITH v AS (SELECT o_orderkey AS k, o_orderkey % 5 AS w, {uuid_sql("'vote:' || o_orderkey")} AS u FROM orders)
    SELECT k::VARCHAR AS claim_id, CASE w WHEN 0 THEN u WHEN 1 THEN u ELSE k::VARCHAR END AS to_object_id, CASE w WHEN 4 THEN 0 ELSE 1 END::INT AS spans FROM v"""
)
def attribution_targets(t: demo.Tables) -> DataFrame:
    """The fact an attribution points to: an id of the claim's own type that is a key, else the claim; and its spans."""
    k = F.col("o_orderkey")
    ident = uuid5(F.concat(F.lit("vote:"), demo.s("o_orderkey")))
    own = F.when(k % 5 == 2, F.lit("no-key")).otherwise(ident)
    kind = F.when(k % 5 == 3, "office_held").otherwise("vote_cast")
    item = F.struct(F.lit("fact").alias("kind"), kind.alias("evidence_type"), F.create_map(F.lit("vote_event_id"), own, F.lit("span_id"), F.when(k % 5 == 4, F.lit("x")).otherwise(ident)).alias("node_ids"), F.lit(None).cast("string").alias("span_id"))
    d = t.orders.select(demo.s("o_orderkey").alias("claim_id"), F.when(k % 5 == 4, F.lit("election_result")).otherwise("vote_cast").alias("claim_type"), F.array(item, item).alias("top"))
    return d.select("claim_id", attribution.target_id(F.col("claim_type"), F.col("top"), F.col("claim_id")).alias("to_object_id"), F.size(attribution.span_ids(F.col("top"))).alias("spans"))


@query("SELECT l_orderkey::VARCHAR AS task_id, l_suppkey * 100000 + l_partkey AS action_seq, '{\"confirmed_span_ids\":[\"s' || l_partkey || '\"]}' AS notes FROM lineitem WHERE l_linenumber % 2 = 1")
def confirmations(t: demo.Tables) -> DataFrame:
    spans = F.when(F.col("l_linenumber") % 2 == 1, F.array(F.concat(F.lit("s"), demo.s("l_partkey")))).otherwise(F.array().cast("array<string>"))
    c = t.lineitem.select(demo.s("l_orderkey").alias("task_id"), demo.s("l_suppkey").alias("actor"), spans.alias("span_ids"), (F.col("l_suppkey") * 100000 + F.col("l_partkey")).alias("action_seq"))
    return review.confirm_evidence(c).select("task_id", "action_seq", "notes")


@query("SELECT o_orderkey::VARCHAR AS claim_id, 'supported' AS status FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def bare_verdicts(t: demo.Tables) -> DataFrame:
    """Verdicts that decide without any evidence."""
    k = F.col("o_orderkey")
    b = t.orders.select(demo.s("o_orderkey").alias("claim_id"), F.when(k % 2 == 0, "supported").otherwise("insufficient_evidence").alias("status"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("top_evidence"))
    return quality.without_evidence(b)


@query("SELECT doc_id::VARCHAR AS document_id FROM documents WHERE doc_id % 4 <> 1")
def unarchived(t: demo.Tables) -> DataFrame:
    uri = F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("doc_id") % 4 == 1, "s3://x").when(F.col("doc_id") % 4 == 2, "")
    return quality.without_archive_uri(t.documents.select(demo.s("doc_id").alias("document_id"), uri.alias("archive_uri")))


# ---------------------------------------------------------------- streams, run to their end


#: Rows of a landed file: a batch has more files, not larger ones, as the input grows.
ROWS_A_FILE = 20_000


def batches(rows: DataFrame, name: str, n: int, files: int = 4) -> tuple[str, T.StructType, int]:
    """About n rows landed for a stream to take in ``files`` batches: folder, schema and files a batch."""
    path, each = shared_folder(rows.sparkSession, name), max(1, -(-n // (files * ROWS_A_FILE)))
    rows.repartition(files * each).write.parquet(path)
    return path, rows.schema, each


def stream_of(rows: DataFrame, name: str, n: int, files: int = 4) -> DataFrame:
    path, schema, each = batches(rows, name, n, files)
    return rows.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(path)


def stream_of_dealt(rows: DataFrame, name: str, files: int) -> DataFrame:
    """Rows that are dealt to tasks already: each task's are landed as a file where they lie, for ``files`` batches."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    landed = len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-landed // files))).parquet(path)


@query("SELECT DISTINCT text FROM documents WHERE text IS NOT NULL")
def stream_dedup_ingest(t: demo.Tables) -> DataFrame:
    """Documents as a stream: each content is kept once, over all micro-batches."""
    jobs.use_rocksdb(t.spark)
    out, mark = shared_folder(t.spark, "deduped"), shared_folder(t.spark, "mark")
    jobs.dedup_stream(stream_of(t.documents.where("text IS NOT NULL").select("text"), "in", t.documents.count()), "text", out, mark).awaitTermination()
    return jobs.appended(t.spark, out).select("text")


@query("SELECT o_custkey AS person_id, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS name, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def stream_upsert(t: demo.Tables) -> DataFrame:
    """Orders as records of persons: the last non-null value of each column, by sequence, over all micro-batches."""
    k = F.col("o_orderkey")
    rows = t.orders.select(F.col("o_custkey").alias("person_id"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("name"), F.col("o_orderstatus").alias("status"), k.alias("seq"))
    path, schema, each = batches(rows, "in", t.orders.count())
    table = shared_folder(t.spark, "table")
    jobs.ingest_stream(t.spark, path, schema, lambda b: b, "person_id", table, shared_folder(t.spark, "mark"), file_format="parquet", compact_every=2, files_each=each).awaitTermination()
    return jobs.current_table(t.spark, table, "person_id")


@query(f"WITH {ACTIONS} SELECT a.id::VARCHAR AS task_id, arg_max(CASE WHEN fin IS NOT NULL AND seq > fin THEN NULL ELSE to_ END, seq) AS status, count(*) AS actions FROM a JOIN e USING (id) GROUP BY a.id")
def stream_review_state(t: demo.Tables) -> DataFrame:
    """Order lines as a stream of review actions, in order; the state a task ends in, and how many actions were logged."""
    _, actions = review_tables(t)
    log, path = shared_folder(t.spark, "audit"), shared_folder(t.spark, "in")
    rows = actions.select("task_id", "action_seq", "actor", "action")
    rows.write.parquet(path)
    jobs.review_log_stream(t.spark.readStream.schema(rows.schema).parquet(path), log, shared_folder(t.spark, "ended"), shared_folder(t.spark, "mark")).awaitTermination()
    log = jobs.appended(t.spark, log)
    return log.groupBy("task_id").agg(F.max_by("status", F.when(F.col("applied"), F.col("action_seq"))).alias("status"), F.count(F.lit(1)).alias("actions"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT time_bucket(INTERVAL 1 DAY, ts)) AS days FROM events GROUP BY event_type")
def stream_windows(t: demo.Tables) -> DataFrame:
    """Events as a stream counted by day: no row is late within the delay."""
    jobs.use_rocksdb(t.spark)
    rows = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = jobs.watermark_counts(stream_of(rows, "in", t.events.count()), "ts", "1 day", "400 days", F.col("event_type"))
    name = f"windows_{t.spark.sparkContext.applicationId.replace('-', '_').replace('.', '_')}"
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_folder(t.spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.table(name).groupBy("event_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"))
