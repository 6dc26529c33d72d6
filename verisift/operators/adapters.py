"""Raw rows -> typed records: one DataFrame function per source. Filters, projections, keys, lookups.

keep: raw columns to carry along, such as a sequence. key: how a kind and an external id become a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import entity_key
from ..functions.text import blank_to_null, normalize_hebrew, safe_timestamp, squeeze, vote_share

#: Office types by position code, and those the government appoints. Fixed values.
POSITION_TYPES = {30: "prime_minister", 39: "committee_chair", 42: "committee_member", 43: "mk", 48: "deputy_speaker", 49: "minister", 50: "deputy_prime_minister", 51: "deputy_minister", 54: "mk", 61: "mk", 65: "committee_chair", 67: "committee_member"}
GOVERNMENT = ["prime_minister", "minister", "deputy_prime_minister", "deputy_minister"]
#: Result codes that are votes. Fixed values.
VOTE_CODES = {1: "for", 2: "against", 3: "abstain"}
#: Share of valid votes a list needs. Fixed value.
THRESHOLD = 0.0325
DECISION_URL = "https://www.gov.il/he/departments/policies/"


def text(c: str) -> Column:
    return F.col(c).cast("string")


def present(c: str) -> Column:
    """Neither null, nor empty, nor zero."""
    return F.coalesce((F.trim(text(c)) != "") & (F.trim(text(c)) != "0"), F.lit(False))


def or_label(name: Column, kind: str, ident: Column) -> Column:
    return F.coalesce(blank_to_null(name), F.concat(F.lit(f"{kind}:"), ident))


def lookup_map(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def people(raw: DataFrame, compose: bool = False, keep: tuple[str, ...] = (), key: Callable[[str, Column], Column] = entity_key) -> DataFrame:
    ident = text("PersonID")
    name = squeeze(F.concat_ws(" ", *[F.nullif(normalize_hebrew(text(c), compose), F.lit("")) for c in ("FirstName", "LastName")]))
    return raw.where(F.col("PersonID").isNotNull() & (ident != "")).select(
        key("knesset_person", ident).alias("person_id"), or_label(name, "person", ident).alias("canonical_name"), F.nullif(name, F.lit("")).alias("hebrew_name"),
        F.create_map(F.lit("knesset_person_id"), ident).alias("external_ids"), F.lit(1).alias("source_tier"), F.coalesce(F.col("IsCurrent").cast("boolean"), F.lit(False)).alias("is_current"), *keep,
    )


def positions(raw: DataFrame, keep: tuple[str, ...] = (), key: Callable[[str, Column], Column] = entity_key) -> dict[str, DataFrame]:
    """Three lanes over one filtered base: party memberships, offices held, position terms."""
    base = raw.where(present("PersonToPositionID") & present("PersonID") & F.col("StartDate").isNotNull() & (F.trim(text("StartDate")) != ""))
    duty, ministry, code = text("DutyDesc"), F.when(present("GovMinistryName"), text("GovMinistryName")), F.col("PositionID").cast("int")
    kind = F.coalesce(lookup_map(POSITION_TYPES, code), blank_to_null(duty), F.lit("unknown"))
    office = F.concat_ws(":", code.cast("string"), F.when(present("GovMinistryID"), text("GovMinistryID")).otherwise("-"))
    base = base.select(
        key("knesset_person", text("PersonID")).alias("person_id"), F.when(present("FactionID"), text("FactionID")).alias("faction"), text("FactionName").alias("faction_name"),
        code.alias("code"), kind.alias("office_type"), office.alias("office_ext"), F.when(kind.isin(GOVERNMENT) & ministry.isNotNull(), ministry).otherwise(F.nullif(duty, F.lit(""))).alias("office_name"),
        key("knesset_position_term", text("PersonToPositionID")).alias("position_term_id"), safe_timestamp(text("StartDate")).alias("valid_from"), safe_timestamp(text("FinishDate")).alias("valid_to"), *keep,
    )
    held = base.where(F.col("code").isNotNull()).withColumn("office_id", key("knesset_office", F.col("office_ext")))
    return {
        "party": base.where(F.col("faction").isNotNull()).select("person_id", key("knesset_party", F.col("faction")).alias("party_id"), or_label(F.col("faction_name"), "party", F.col("faction")).alias("party_name"), "valid_from", "valid_to", *keep),
        "office": held.select("person_id", "office_id", F.col("office_name").alias("canonical_name"), "office_type", F.lit("national").alias("scope"), "valid_from", "valid_to", *keep),
        "term": held.select("position_term_id", "person_id", "office_id", F.when(F.col("office_type").isin(GOVERNMENT), "government").otherwise("knesset").alias("appointing_body"), "valid_from", "valid_to", F.lit(False).alias("is_acting"), *keep),
    }


def committees(raw: DataFrame, keep: tuple[str, ...] = (), key: Callable[[str, Column], Column] = entity_key) -> DataFrame:
    ident = text("CommitteeID")
    return raw.where(present("CommitteeID")).select(key("knesset_committee", ident).alias("committee_id"), or_label(text("Name"), "committee", ident).alias("canonical_name"), blank_to_null(text("Name")).alias("hebrew_name"), *keep)


def committee_memberships(raw: DataFrame, lookup: DataFrame, keep: tuple[str, ...] = (), key: Callable[[str, Column], Column] = entity_key) -> DataFrame:
    """lookup: (mk_individual_id, PersonID), one row a member."""
    rows = raw.where(present("mk_individual_id") & present("committee_id") & F.col("start_date").isNotNull() & (F.trim("start_date") != ""))
    rows = rows.withColumn("mk_individual_id", F.trim("mk_individual_id")).join(lookup, "mk_individual_id")
    return rows.select(
        key("knesset_person", text("PersonID")).alias("person_id"), key("knesset_committee", F.trim("committee_id")).alias("committee_id"), F.col("committee_name"),
        safe_timestamp(F.col("start_date")).alias("valid_from"), safe_timestamp(F.col("finish_date")).alias("valid_to"), F.trim("knesset").try_cast("int").alias("knesset_number"), *keep,
    )


def bills(raw: DataFrame, keep: tuple[str, ...] = (), key: Callable[[str, Column], Column] = entity_key) -> DataFrame:
    ident = text("BillID")
    return raw.where(present("BillID")).select(
        key("knesset_bill", ident).alias("bill_id"), or_label(text("Name"), "bill", ident).alias("title"), F.col("KnessetNum").cast("int").alias("knesset_number"),
        F.when(present("StatusID"), F.concat(F.lit("status:"), text("StatusID"))).alias("status"), *keep,
    )


def bill_initiators(raw: DataFrame, keep: tuple[str, ...] = (), key: Callable[[str, Column], Column] = entity_key) -> DataFrame:
    ok = present("BillInitiatorID") & present("BillID") & present("PersonID") & F.coalesce(F.col("IsInitiator").cast("boolean"), F.lit(False))
    return raw.where(ok).select(key("knesset_person", text("PersonID")).alias("person_id"), key("knesset_bill", text("BillID")).alias("bill_id"), F.col("Ordinal").cast("int").alias("ordinal"), *keep)


def votes(raw: DataFrame, keep: tuple[str, ...] = (), key: Callable[[str, Column], Column] = entity_key) -> DataFrame:
    """Events and edges in one table: ``value`` is null where the code is no vote (an event, no edge)."""
    member = F.regexp_replace(F.trim("kmmbr_id"), "^0+", "")
    code = F.coalesce(F.trim("vote_result").try_cast("int"), F.lit(0))
    return raw.where(present("vote_id") & F.col("kmmbr_id").isNotNull() & (F.trim("kmmbr_id") != "")).select(
        key("knesset_vote", F.trim("vote_id")).alias("vote_event_id"), key("knesset_person", F.when(member == "", "0").otherwise(member)).alias("person_id"),
        F.trim("kmmbr_name").alias("person_name"), lookup_map(VOTE_CODES, code).alias("value"), *keep,
    )


def attendance(raw: DataFrame, lookup: DataFrame, keep: tuple[str, ...] = (), key: Callable[[str, Column], Column] = entity_key) -> tuple[DataFrame, DataFrame]:
    """(events, edges): sessions without readable attendees still give an event; unknown attendees are dropped."""
    base = raw.where(present("CommitteeSessionID") & present("CommitteeID")).select(
        key("knesset_session", text("CommitteeSessionID")).alias("attendance_event_id"), key("knesset_committee", text("CommitteeID")).alias("committee_id"),
        safe_timestamp(text("StartDate")).alias("occurred_at"), F.from_json("attended_mk_individual_ids", "array<string>").alias("_ids"), *keep,
    )
    edges = base.select("attendance_event_id", *keep, F.explode_outer(F.filter(F.transform("_ids", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))).alias("mk_individual_id")).where("mk_individual_id IS NOT NULL")
    edges = edges.join(lookup, "mk_individual_id").select(key("knesset_person", text("PersonID")).alias("person_id"), "attendance_event_id", F.lit("present").alias("presence"), *keep)
    return base.drop("_ids"), edges.distinct()


def election_results(rows: DataFrame, mapping: DataFrame, keep: tuple[str, ...] = (), key: Callable[[str, Column], Column] = entity_key) -> DataFrame:
    """rows of result tables with knesset_number and election_date; mapping: (knesset_number, ballot_letters, faction_id).

    Lists without a faction keep a key of their own; an election that the mapping does not know at all is an error.
    """
    known = mapping.groupBy("knesset_number").agg(F.lit(True).alias("_known"))
    r = rows.where(F.trim("ballot_letters") != "").join(mapping, ["knesset_number", "ballot_letters"], "left").join(known, "knesset_number", "left")
    check = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no list mapping for election "), F.col("knesset_number").cast("string")))).otherwise(F.col("knesset_number"))
    ident = F.concat_ws(":", check.cast("string"), F.col("ballot_letters"))
    needed = F.ceil(F.col("valid_votes") * F.lit(THRESHOLD))
    return r.select(
        key("cec_election", ident).alias("election_result_id"), F.col("election_date").cast("timestamp").alias("election_date"), "knesset_number", "list_name", "ballot_letters",
        F.coalesce(key("knesset_party", F.col("faction_id")), key("cec_list", ident)).alias("list_party_id"), "votes", "seats_won", vote_share(F.col("vote_share_pct")).alias("vote_share"),
        (F.col("votes") >= needed).alias("passed_threshold"), *keep,
    )


def government_decisions(hits: DataFrame, keep: tuple[str, ...] = (), key: Callable[[str, Column], Column] = entity_key) -> DataFrame:
    return hits.select(
        key("budgetkey_gov_decision", F.col("id")).alias("government_decision_id"), F.col("procedure_number_str").alias("decision_number"),
        F.nullif(F.regexp_extract("government", r"ה-?\s*(\d+)", 1), F.lit("")).try_cast("int").alias("government_number"), safe_timestamp(F.col("publish_date")).alias("decision_date"),
        "title", F.nullif(F.substring(F.trim("text"), 1, 2000), F.lit("")).alias("summary"), F.col("office").alias("issuing_body"), F.concat(F.lit(DECISION_URL), F.nullif(F.col("url_id"), F.lit(""))).alias("source_url"), *keep,
    )


def enrich_votes(events: DataFrame, headers: DataFrame, bill_keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """headers (vote_event_id, bill_id, occurred_at, vote_type): -> (events with null-keeping updates, event-bill edges, counts)."""
    h = headers.where(F.col("vote_event_id").isNotNull() & F.col("bill_id").isNotNull())
    new = h.select("vote_event_id", *[F.col(c).alias(f"_{c}") for c in ("bill_id", "occurred_at", "vote_type")])
    updated = events.join(new, "vote_event_id", "left").select("vote_event_id", *[F.coalesce(f"_{c}", c).alias(c) for c in ("bill_id", "occurred_at", "vote_type")])
    hit = h.join(events.select("vote_event_id"), "vote_event_id", "left_semi")
    edges = hit.join(bill_keys.select("bill_id"), "bill_id", "left_semi").select("vote_event_id", "bill_id").distinct()
    counts = h.select("vote_event_id").distinct().join(edges.select("vote_event_id", F.lit(1).alias("l")).distinct(), "vote_event_id", "left").agg(F.count("l").alias("linked"), F.count_if(F.col("l").isNull()).alias("missing"))
    return updated, edges, counts
