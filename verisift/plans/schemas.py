"""Tables, domains and constant tables of the statement checker."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
STRINGS = T.ArrayType(S)
MAP = T.MapType(S, S)


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


TIME_SCOPE = table(start=TS, end=TS, granularity=S)
CONFIDENCE = table(source_authority=D, directness=D, temporal_alignment=D, entity_resolution=D, cross_source_consistency=D, overall=D)
SLOTS = ["speaker_person_id", "target_person_id", "bill_id", "committee_id", "office_id", "vote_value", "party_id", "expected_seats", "expect_passed_threshold", "government_decision_id"]

#: Entity and run tables by name; the first column is the key.
TABLES: dict[str, T.StructType] = {
    "person": table(person_id=S, canonical_name=S, hebrew_name=S, english_name=S, external_ids=MAP, source_tier=I),
    "party": table(party_id=S, canonical_name=S, hebrew_name=S, english_name=S, abbreviation=S),
    "office": table(office_id=S, canonical_name=S, office_type=S, scope=S, hebrew_name=S),
    "committee": table(committee_id=S, canonical_name=S, hebrew_name=S),
    "bill": table(bill_id=S, title=S, knesset_number=I, status=S, hebrew_name=S),
    "vote_event": table(vote_event_id=S, bill_id=S, occurred_at=TS, vote_type=S),
    "attendance_event": table(attendance_event_id=S, committee_id=S, occurred_at=TS),
    "membership_term": table(membership_term_id=S, person_id=S, org_id=S, org_type=S, valid_from=TS, valid_to=TS),
    "position_term": table(position_term_id=S, person_id=S, office_id=S, appointing_body=S, valid_from=TS, valid_to=TS, is_acting=B, source_document_id=S),
    "election_result": table(election_result_id=S, election_date=TS, knesset_number=I, list_name=S, ballot_letters=S, list_party_id=S, votes=L, seats_won=I, vote_share=D, passed_threshold=B, source_document_id=S),
    "government_decision": table(government_decision_id=S, decision_number=S, government_number=I, decision_date=TS, title=S, summary=S, issuing_body=S, source_document_id=S, source_url=S),
    "source_document": table(document_id=S, source_family=S, source_tier=I, source_type=S, url=S, archive_uri=S, content_sha256=S, captured_at=TS, language=S, title=S, body=S),
    "evidence_span": table(span_id=S, document_id=S, source_tier=I, source_type=S, url=S, archive_uri=S, text=S, normalized_text=S, char_start=I, char_end=I, captured_at=TS),
    "atomic_claim": table(claim_id=S, raw_text=S, normalized_text=S, claim_type=S, **dict.fromkeys(SLOTS, S), time_scope=TIME_SCOPE, checkability=S, created_at=TS),
    "verdict": table(verdict_id=S, claim_id=S, status=S, confidence=CONFIDENCE, summary=S, needs_human_review=B, model_version=S, ruleset_version=S, created_at=TS),
    "declaration": table(declaration_id=S, speaker_person_id=S, utterance_text=S, utterance_language=S, utterance_time=TS, source_kind=S, source_document_id=S, claim_family=S, checkability=S, derived_atomic_claim_ids=STRINGS, created_at=TS),
    "attribution_edge": table(attribution_id=S, from_declaration_id=S, to_object_id=S, to_object_type=S, relation_type=S, evidence_span_ids=STRINGS, confidence_band=S, review_status=S, created_at=TS),
    "entity_alias": table(entity_kind=S, alias_text=S, alias_locale=S, canonical_entity_id=S, confidence=I),
    "entity_candidate": table(candidate_id=S, mention_text=S, entity_kind=S, canonical_entity_id=S, confidence=D, method=S, evidence=S),
    "statement": table(statement_id=S, text=S, language=S, source_url=S, received_at=TS),
    "statement_claim": table(statement_id=S, claim_id=S, claim_type=S, checkability=S, method=S, slots=MAP, time_scope=TIME_SCOPE),
    "review_task": table(task_id=S, kind=S, status=S, priority=I, payload=S, assigned_to=S, created_at=TS),
    "review_action": table(action_id=S, task_id=S, actor=S, action=S, diff=S, created_at=TS),
    "ingest_run": table(run_id=S, source_family=S, adapter=S, started_at=TS, finished_at=TS, status=S, stats=MAP),
    "raw_fetch_object": table(content_sha256=S, object_id=S, source_url=S, archive_uri=S, content_type=S, byte_size=L, captured_at=TS, source_tier=I),
    "normalized_record": table(record_id=S, record_kind=S, payload=S, source_tier=I),
    "source_manifest": table(family=S, adapter=S, source_url=S, source_tier=I, parser=S, cadence_cron=S, entity_hints=MAP),
}
ENTITY_KEYS = {k: TABLES[k].names[0] for k in list(TABLES)[:16]}

#: Edge tables: name -> (source table, target table, properties, allowed values). Fixed values.
EDGES: dict[str, tuple[str, str, list[str]]] = {
    "cast_vote": ("person", "vote_event", ["value"]),
    "attended": ("person", "attendance_event", ["presence"]),
    "sponsored": ("person", "bill", []),
    "member_of": ("person", "party", ["valid_from", "valid_to"]),
    "held_office": ("person", "office", ["valid_from", "valid_to"]),
    "member_of_committee": ("person", "committee", ["valid_from", "valid_to"]),
    "has_position_term": ("person", "position_term", []),
    "about_office": ("position_term", "office", []),
    "about_bill": ("atomic_claim", "bill", []),
    "vote_event_about_bill": ("vote_event", "bill", []),
    "about_person": ("evidence_span", "person", []),
    "for_party": ("election_result", "party", []),
    "has_span": ("source_document", "evidence_span", []),
    "supported_by": ("verdict", "evidence_span", []),
    "contradicted_by": ("verdict", "evidence_span", []),
    "evaluates": ("verdict", "atomic_claim", []),
    "derives": ("declaration", "atomic_claim", []),
    "from_source": ("declaration", "source_document", []),
    "said_by": ("declaration", "person", []),
    "refers_to": ("declaration", "vote_event", []),
    "refers_to_gov_decision": ("declaration", "government_decision", []),
    "concerns": ("declaration", "person", []),
    "concerns_committee": ("declaration", "committee", []),
    "concerns_office": ("declaration", "office", []),
    "concerns_party": ("declaration", "party", []),
}
EDGE_DOMAINS = {"value": ["for", "against", "abstain"], "presence": ["present", "absent", "partial"]}

#: Closed domains. Fixed values.
CLAIM_TYPES = ["vote_cast", "bill_sponsorship", "office_held", "committee_membership", "committee_attendance", "statement_about_formal_action", "election_result", "government_decision"]
DOMAINS: dict[str, list] = {
    "claim_type": CLAIM_TYPES,
    "checkability": ["checkable", "non_checkable", "insufficient_time_scope", "insufficient_entity_resolution"],
    "vote_value": ["for", "against", "abstain"],
    "status": ["supported", "contradicted", "mixed", "insufficient_evidence", "non_checkable"],
    "relation_type": ["contradicted_by", "entity_ambiguous", "time_scope_mismatch", "not_checkable_against_record", "overstates", "underspecifies", "supported_by"],
    "confidence_band": ["high", "medium", "low", "uncertain"],
    "source_tier": [1, 2, 3],
    "granularity": ["day", "month", "year", "term", "unknown"],
    "entity_kind": ["person", "party", "office", "committee", "bill"],
    "task_kind": ["entity_resolution", "verdict", "conflict", "declaration"],
    "task_status": ["open", "claimed", "resolved", "escalated"],
    "action": ["approve", "reject", "relink", "annotate", "escalate"],
    "claim_family": ["formal_action", "position_claim", "electoral_claim", "policy_claim", "rhetorical", "unknown"],
}

#: claim type -> (required, optional) slots; all others are forbidden. Fixed values.
SLOT_TEMPLATES: dict[str, tuple[list[str], list[str]]] = {
    "vote_cast": (["speaker_person_id", "bill_id", "vote_value"], ["target_person_id"]),
    "bill_sponsorship": (["speaker_person_id", "bill_id"], ["target_person_id"]),
    "office_held": (["speaker_person_id", "office_id"], ["target_person_id"]),
    "committee_membership": (["speaker_person_id", "committee_id"], ["target_person_id"]),
    "committee_attendance": (["speaker_person_id", "committee_id"], ["target_person_id"]),
    "statement_about_formal_action": (["speaker_person_id"], ["target_person_id", "bill_id", "committee_id", "office_id", "vote_value"]),
    "election_result": (["party_id"], ["speaker_person_id", "target_person_id", "expected_seats", "expect_passed_threshold"]),
    "government_decision": (["government_decision_id"], ["speaker_person_id", "target_person_id", "office_id"]),
}
TIME_REQUIRED = ["vote_cast", "committee_attendance"]
SLOT_KINDS = {"speaker_person_id": "person", "target_person_id": "person", "bill_id": "bill", "committee_id": "committee", "office_id": "office", "party_id": "party", "government_decision_id": "government_decision"}

#: Term number, first day, last day (none: current). Fixed values.
TERM_CALENDAR = [
    (1, "1949-02-14", "1951-08-20"), (2, "1951-08-20", "1955-08-15"), (3, "1955-08-15", "1959-12-04"), (4, "1959-12-04", "1961-09-04"),
    (5, "1961-09-04", "1965-11-22"), (6, "1965-11-22", "1969-11-17"), (7, "1969-11-17", "1974-01-21"), (8, "1974-01-21", "1977-06-13"),
    (9, "1977-06-13", "1981-07-20"), (10, "1981-07-20", "1984-08-13"), (11, "1984-08-13", "1988-11-21"), (12, "1988-11-21", "1992-07-13"),
    (13, "1992-07-13", "1996-06-17"), (14, "1996-06-17", "1999-06-07"), (15, "1999-06-07", "2003-02-17"), (16, "2003-02-17", "2006-04-17"),
    (17, "2006-04-17", "2009-02-24"), (18, "2009-02-24", "2013-02-05"), (19, "2013-02-05", "2015-03-31"), (20, "2015-03-31", "2019-04-30"),
    (21, "2019-04-30", "2019-10-03"), (22, "2019-10-03", "2020-03-16"), (23, "2020-03-16", "2020-12-22"), (24, "2020-12-22", "2022-11-15"),
    (25, "2022-11-15", None),
]

#: Evidence axes and their weights, in the order of the confidence vector. Fixed values.
WEIGHTS = {"source_tier_score": 0.30, "directness": 0.25, "temporal_alignment": 0.20, "entity_resolution": 0.15, "cross_source_consistency": 0.10}
ABSTAIN_BELOW, REVIEW_BELOW = 0.45, 0.62

#: One evidence row: facts and text hits side by side, typed properties instead of a map of strings.
EVIDENCE = table(
    claim_id=S, evidence_type=S, kind=S, node_ids=MAP, source_document_ids=STRINGS, source_tier=I, occurred_at=TS, vote_value=S, presence=S, seats_won=I, passed_threshold=B, term_number=I,
    decision_number=S, government_number=I, title=S, canonical_name=S, office_type=S, appointing_body=S, valid_from=TS, valid_to=TS, is_acting=B, mention_count=L,
    span_id=S, document_id=S, text=S, captured_at=TS, score=D, properties=MAP,
)
