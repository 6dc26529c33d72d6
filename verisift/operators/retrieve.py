"""Fact retrieval for all claims at once, one operator a claim type, with a limit for each claim.

claims: claim_id, claim_type, resolved ids (speaker_person_id, bill_id, office_id, committee_id, party_id,
government_decision_id), decision_number, government_number, time_start, time_end. An absent bound is open. Only equality
conditions are join keys; the time conditions are residual, so no plan falls back to a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schemas import EVIDENCE


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group (row_number, which Spark turns into a limit before the shuffle)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def inside(at: Column) -> Column:
    """Event time within the claim's scope."""
    return (F.col("time_start").isNull() | (at >= F.col("time_start"))) & (F.col("time_end").isNull() | (at <= F.col("time_end")))


def overlaps(start: Column, end: Column) -> Column:
    """Term [start, end] meets the claim's scope; a null end is open."""
    return (F.col("time_start").isNull() | end.isNull() | (end >= F.col("time_start"))) & (F.col("time_end").isNull() | (start <= F.col("time_end")))


def node_ids(**ids: Column) -> Column:
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in ids]), F.array(*[v.cast("string") for v in ids.values()]))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def evidence(df: DataFrame, claim_type: str, ids: dict[str, Column], tier: int = 1, **columns: Column) -> DataFrame:
    """Rows of the evidence schema; what a claim type does not have is null, {} or []."""
    given = {"claim_id": F.col("claim_id"), "evidence_type": F.lit(claim_type), "kind": F.lit("fact"), "node_ids": node_ids(**ids), "source_tier": F.lit(tier), **columns}
    given.setdefault("source_document_ids", F.array().cast("array<string>"))
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVIDENCE.fields])


def of_type(claims: DataFrame, claim_type: str, *needed: str) -> DataFrame:
    out = claims.where(F.col("claim_type") == claim_type)
    for c in needed:
        out = out.where(F.col(c).isNotNull())
    return out


def documents_of(links: DataFrame | None, key: str) -> DataFrame | None:
    """(fact key, document) links -> the distinct documents of each fact."""
    return None if links is None else links.groupBy(key).agg(F.array_sort(F.collect_set("document_id")).alias("source_document_ids"))


def with_documents(df: DataFrame, links: DataFrame | None, key: str) -> DataFrame:
    docs = documents_of(links, key)
    if docs is None:
        return df.withColumn("source_document_ids", F.array().cast("array<string>"))
    return df.join(docs, key, "left").withColumn("source_document_ids", F.coalesce("source_document_ids", F.array().cast("array<string>")))


def own_document(c: str = "source_document_id") -> Column:
    return F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


#: Distinct claim keys that are broadcast to cut fact tables down before they are joined with each other.
FEW_KEYS = 100_000


def asked_for(facts: DataFrame, claims: DataFrame, fact_key: str, claim_key: str) -> DataFrame:
    """The facts that a claim may ask for. Few keys (a checked number) are broadcast, so that the facts are filtered where
    they lie; with more, most facts are asked for and stay as they are."""
    keys = claims.select(F.col(claim_key).alias(fact_key)).distinct()
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return facts.join(F.broadcast(keys), fact_key, "left_semi") if few else facts


#: Bits of the filter on asked keys at most (16 MB), and so many for each claim below that.
FILTER_BITS, BITS_A_CLAIM = 1 << 27, 16


def near_asked(facts: DataFrame, claims: DataFrame, *keys: str) -> DataFrame:
    """All facts that a claim asks for by these keys together, and few others, so that the rest is not shuffled to the claims.

    A bitmap over hashes, made by Spark in words of 4 KB and broadcast; its size is bounded, so more claims make it less sharp but
    never wrong. The exact join follows it.
    """
    bits = min(FILTER_BITS, 1 << max(15, (claims.count() * BITS_A_CLAIM).bit_length()))
    slot = F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1))
    word, place = F.shiftright(slot, 15), slot.bitwiseAND(F.lit(32767))
    bitmap = claims.groupBy(word.alias("_word")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return facts.withColumn("_word", word).join(F.broadcast(bitmap), "_word").where(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("_word", "_bits")


def vote_cast(claims: DataFrame, kb: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """kb: cast_vote (person_id, vote_event_id, value), vote_event (with bill_id), bill, vote_documents (optional)."""
    c = of_type(claims, "vote_cast", "speaker_person_id", "bill_id")
    cast, events = asked_for(kb["cast_vote"], c, "person_id", "speaker_person_id"), asked_for(kb["vote_event"], c, "bill_id", "bill_id")
    votes = cast.withColumnRenamed("person_id", "speaker_person_id").join(events.select("vote_event_id", "bill_id", "occurred_at"), "vote_event_id")
    votes = near_asked(votes, c, "speaker_person_id", "bill_id")
    votes = with_documents(votes, kb.get("vote_documents"), "vote_event_id")  # where votes and events already lie by event
    asked = c.select("claim_id", "speaker_person_id", "bill_id", "time_start", "time_end").join(kb["bill"].select("bill_id", "title"), "bill_id")
    f = asked.join(votes, ["speaker_person_id", "bill_id"]).where(inside(F.col("occurred_at")))
    f = top_k(f, ["claim_id"], [F.col("occurred_at").desc_nulls_last(), F.col("vote_event_id")], k)  # ranking and verdicts go on by claim
    ids = {x: F.col(x) for x in ("speaker_person_id", "vote_event_id", "bill_id")}
    return evidence(f, "vote_cast", ids, vote_value=F.col("value"), occurred_at=F.col("occurred_at"), title=F.col("title"), source_document_ids=F.col("source_document_ids"))


def bill_sponsorship(claims: DataFrame, kb: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """kb: sponsored (person_id, bill_id, sponsored_at), bill, bill_documents (optional)."""
    c = of_type(claims, "bill_sponsorship", "speaker_person_id", "bill_id")
    f = c.join(kb["sponsored"].withColumnRenamed("person_id", "speaker_person_id"), ["speaker_person_id", "bill_id"]).join(kb["bill"].select("bill_id", "title", "knesset_number"), "bill_id")
    f = with_documents(top_k(f, ["claim_id"], [F.col("sponsored_at"), F.col("bill_id")], k), kb.get("bill_documents"), "bill_id")
    ids = {x: F.col(x) for x in ("speaker_person_id", "bill_id")}
    return evidence(f, "bill_sponsorship", ids, title=F.col("title"), term_number=F.col("knesset_number"), source_document_ids=F.col("source_document_ids"))


def office_held(claims: DataFrame, kb: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """Position terms, and older held_office edges for pairs without any term; distinct; the limit is after the union.

    kb: position_term, office, held_office (person_id, office_id, valid_from, valid_to; optional).
    """
    c = of_type(claims, "office_held", "speaker_person_id", "office_id")
    office = kb["office"].select("office_id", "canonical_name", "office_type")
    terms = kb["position_term"].withColumnRenamed("person_id", "speaker_person_id")
    new = c.join(terms, ["speaker_person_id", "office_id"]).where(overlaps(F.col("valid_from"), F.col("valid_to")))
    cols = ["claim_id", "speaker_person_id", "office_id", "position_term_id", "appointing_body", "valid_from", "valid_to", "is_acting", "source_document_id"]
    rows = new.select(*cols)
    if "held_office" in kb:
        old = c.join(kb["held_office"].withColumnRenamed("person_id", "speaker_person_id"), ["speaker_person_id", "office_id"]).where(overlaps(F.col("valid_from"), F.col("valid_to")))
        old = old.join(terms.select("speaker_person_id", "office_id").distinct(), ["speaker_person_id", "office_id"], "left_anti")
        rows = rows.unionByName(old.select("claim_id", "speaker_person_id", "office_id", "valid_from", "valid_to"), allowMissingColumns=True).distinct()
    f = top_k(rows.join(office, "office_id"), ["claim_id"], [F.col("valid_from").desc_nulls_last(), F.col("position_term_id")], k)
    ids = {x: F.col(x) for x in ("speaker_person_id", "office_id", "position_term_id")}
    props = {x: F.col(x) for x in ("canonical_name", "office_type", "appointing_body", "valid_from", "valid_to", "is_acting")}
    return evidence(f, "office_held", ids, source_document_ids=own_document(), **props)


def committee_membership(claims: DataFrame, kb: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """kb: member_of_committee (person_id, committee_id, valid_from, valid_to), committee."""
    c = of_type(claims, "committee_membership", "speaker_person_id", "committee_id")
    f = c.join(kb["member_of_committee"].withColumnRenamed("person_id", "speaker_person_id"), ["speaker_person_id", "committee_id"])
    f = f.where(overlaps(F.col("valid_from"), F.col("valid_to"))).join(kb["committee"].select("committee_id", "canonical_name"), "committee_id")
    f = top_k(f, ["claim_id"], [F.col("valid_from").desc_nulls_last(), F.col("valid_to").asc_nulls_first()], k)
    ids = {x: F.col(x) for x in ("speaker_person_id", "committee_id")}
    return evidence(f, "committee_membership", ids, **{x: F.col(x) for x in ("canonical_name", "valid_from", "valid_to")})


def committee_attendance(claims: DataFrame, kb: dict[str, DataFrame], k: int = 20) -> DataFrame:
    """kb: attended (person_id, attendance_event_id, presence), attendance_event."""
    c = of_type(claims, "committee_attendance", "speaker_person_id", "committee_id")
    attended, sessions = asked_for(kb["attended"], c, "person_id", "speaker_person_id"), asked_for(kb["attendance_event"], c, "committee_id", "committee_id")
    seen = attended.withColumnRenamed("person_id", "speaker_person_id").join(sessions, "attendance_event_id")
    f = c.join(seen, ["speaker_person_id", "committee_id"]).where(inside(F.col("occurred_at")))
    f = top_k(f, ["claim_id"], [F.col("occurred_at").desc_nulls_last(), F.col("attendance_event_id")], k)
    ids = {x: F.col(x) for x in ("speaker_person_id", "committee_id", "attendance_event_id")}
    return evidence(f, "committee_attendance", ids, presence=F.col("presence"), occurred_at=F.col("occurred_at"))


def election_result(claims: DataFrame, kb: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """kb: election_result (list_party_id names the party)."""
    c = of_type(claims, "election_result", "party_id")
    f = c.join(kb["election_result"].withColumnRenamed("list_party_id", "party_id"), "party_id").where(inside(F.col("election_date")))
    f = top_k(f, ["claim_id"], [F.col("knesset_number").desc_nulls_last(), F.col("election_result_id")], k)
    ids = {x: F.col(x) for x in ("party_id", "election_result_id")}
    return evidence(f, "election_result", ids, seats_won=F.col("seats_won"), passed_threshold=F.col("passed_threshold"), term_number=F.col("knesset_number"), title=F.col("list_name"), source_document_ids=own_document())


def government_decision(claims: DataFrame, kb: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """By id where it is known, else by number (and government number if given): two equi-joins, not one OR."""
    c, d = of_type(claims, "government_decision"), kb["government_decision"]
    d = d.select(F.col("government_decision_id").alias("_id"), F.col("decision_number").alias("_number"), F.col("government_number").alias("_gov"), "decision_date", "title", "source_document_id")
    direct = c.join(d, F.col("government_decision_id") == F.col("_id"))
    number = c.where(F.col("government_decision_id").isNull()).join(d, F.col("decision_number") == F.col("_number")).where(F.col("government_number").isNull() | (F.col("government_number") == F.col("_gov")))
    f = direct.unionByName(number).where(inside(F.col("decision_date")))
    f = top_k(f, ["claim_id"], [F.col("decision_date").desc_nulls_last(), F.col("_id")], k)
    return evidence(f, "government_decision", {"government_decision_id": F.col("_id")}, decision_number=F.col("_number"), government_number=F.col("_gov"), title=F.col("title"), source_document_ids=own_document())


def statement_about_formal_action(claims: DataFrame, kb: dict[str, DataFrame]) -> DataFrame:
    """How many spans mention the speaker (tier 2, one row a claim). kb: person, about_person (span_id, person_id)."""
    c = of_type(claims, "statement_about_formal_action", "speaker_person_id")
    spans = kb["about_person"].groupBy("person_id").agg(F.array_sort(F.collect_set("span_id")).alias("source_document_ids"))
    f = c.join(kb["person"].select(F.col("person_id").alias("speaker_person_id"), "canonical_name"), "speaker_person_id").join(spans.withColumnRenamed("person_id", "speaker_person_id"), "speaker_person_id", "left")
    docs = F.coalesce("source_document_ids", F.array().cast("array<string>"))
    return evidence(f, "statement_about_formal_action", {"speaker_person_id": F.col("speaker_person_id")}, tier=2, canonical_name=F.col("canonical_name"), mention_count=F.size(docs), source_document_ids=docs)


#: One retrieval a claim type; new types are added here.
REGISTRY: dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]] = {
    f.__name__: f for f in (vote_cast, bill_sponsorship, office_held, committee_membership, committee_attendance, election_result, government_decision, statement_about_formal_action)
}


def retrieve(claims: DataFrame, kb: dict[str, DataFrame], types: list[str] | None = None, registry: dict | None = None) -> DataFrame:
    """Evidence of all claims. types: the claim types to run (all registered ones by default, none if the list is empty); an unknown one is an error."""
    registry = registry or REGISTRY
    unknown = [t for t in types or [] if t not in registry]
    if unknown:
        raise ValueError(f"no retrieval for claim types {unknown}")
    parts = [registry[t](claims, kb) for t in (list(registry) if types is None else types)]
    out = parts[0] if parts else nothing(claims)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nothing(claims: DataFrame) -> DataFrame:
    """No evidence, known as empty when a plan is made, so what joins with it moves nothing."""
    return claims.limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in EVIDENCE.fields])


def terms_as_of(terms: DataFrame, dates: DataFrame, key: str = "person_id", on: str = "as_of") -> DataFrame:
    """Terms valid at a date (both ends included, a null end is open), by start, nulls last."""
    hit = dates.join(terms, key).where((F.col("valid_from") <= F.col(on)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col(on))))
    return hit.withColumn("place", F.row_number().over(Window.partitionBy(key, on).orderBy(F.asc_nulls_last("valid_from"), "term_id")))
