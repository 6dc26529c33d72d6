"""The whole check: statements -> claims -> resolved claims -> evidence -> ranking -> verdicts with provenance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_uuid
from ..functions.text import parse_bool, parse_int
from ..operators import attribution, extract, lexical, rank, resolve, retrieve, verdict
from .materialise import kept
from .schemas import SLOTS


@dataclass
class KnowledgeBase:
    """Tables the check reads. facts: what the retrievals need; entities and aliases: for resolution (None: offline)."""

    facts: dict[str, DataFrame]
    entities: DataFrame | None = None
    aliases: DataFrame | None = None
    names: DataFrame | None = None
    spans: DataFrame | None = None
    text_k: int = 20
    fuzzy: bool = True
    notes: DataFrame | None = field(default=None)


def retrieval_claims(claims: DataFrame) -> DataFrame:
    """Resolved claims in the shape the retrievals read: ids from resolution, a decision number where the id is not one."""
    ident = lambda s: F.try_element_at("resolved_ids", F.lit(s))
    slots = ["speaker_person_id", "bill_id", "committee_id", "office_id", "party_id"]
    out = claims.withColumns({s: ident(s) for s in slots})
    raw, resolved = F.col("government_decision_id"), ident("government_decision_id")
    known = F.when(is_uuid(resolved), resolved).when(is_uuid(raw), raw)
    return out.withColumns(
        {
            "decision_number": F.when(known.isNull(), raw), "government_decision_id": known, "government_number": parse_int(F.col("government_number")), "time_start": F.col("time_scope.start"), "time_end": F.col("time_scope.end"),
            "expected_vote_value": F.col("vote_value"), "expected_seats": parse_int(F.col("expected_seats")), "expect_passed_threshold": parse_bool(F.col("expect_passed_threshold")),
        }
    )


def for_check(claims: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Claims as the check reads them, written once: texts only where they are searched for."""
    text = ["normalized_text"] if kb.spans is not None else []
    return kept(claims.select("claim_id", *OWNER, "claim_type", *SLOTS, "government_number", "time_scope", *text), "claims")


def check_claims(claims: DataFrame, kb: KnowledgeBase, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(bundles with the claims' statement_id and position, ranked evidence) of claims from ``for_check``.

    Only checkable claims are written again, retrieved for and shuffled, and of the facts only those of the claim types
    that occur among them; all others get their verdict where they lie. keep: the bundles of checkable claims are written, as
    several tables are made of them.
    """
    resolved = resolve.resolve_claims(claims, kb.entities, kb.aliases, kb.names, kb.fuzzy)
    ready = retrieval_claims(resolved.withColumn("checkability", extract.claim_checkability(resolved)))
    open_ = kept(ready.where("checkability = 'checkable'"), "open")
    types = [r.claim_type for r in open_.select("claim_type").distinct().collect()]
    found = retrieve.retrieve(open_, kb.facts, [t for t in retrieve.REGISTRY if t in types and _has(t, kb.facts)])
    if kb.spans is not None and types:
        hits = lexical.search(open_.select(F.col("claim_id").alias("query_id"), F.col("normalized_text").alias("query")), kb.spans, kb.text_k)
        found = found.unionByName(lexical.text_evidence(hits))
    ranked = rank.score(found, open_)
    checked = verdict.bundles(open_, ranked, kb.notes, carry=OWNER)
    checked = kept(checked, "checked") if keep else checked
    rest = verdict.bundles(ready.where("checkability <> 'checkable'"), ranked.limit(0), kb.notes, carry=OWNER)
    return rest.unionByName(checked), ranked


#: Where a claim stands. Fixed values.
OWNER = ["statement_id", "position"]
#: What each retrieval reads. Fixed values.
NEEDS = {
    "vote_cast": ["cast_vote", "vote_event", "bill"], "bill_sponsorship": ["sponsored", "bill"], "office_held": ["position_term", "office"], "committee_membership": ["member_of_committee", "committee"],
    "committee_attendance": ["attended", "attendance_event"], "election_result": ["election_result"], "government_decision": ["government_decision"], "statement_about_formal_action": ["about_person", "person"],
}


def _has(claim_type: str, facts: dict[str, DataFrame]) -> bool:
    return all(t in facts for t in NEEDS.get(claim_type, []))


def verify(statements: DataFrame, kb: KnowledgeBase, reference_date: Column | None = None, answers: DataFrame | None = None) -> DataFrame:
    """statements (statement_id, text, language) -> one bundle a claim."""
    return check_claims(for_check(extract.extract(statements, reference_date, answers)[0], kb), kb)[0]


def verify_declarations(utterances: DataFrame, kb: KnowledgeBase, reference_date: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """utterances: declaration_id, text, language, uttered_at -> (declarations, attribution edges, review tasks)."""
    statements = utterances.select(F.col("declaration_id").alias("statement_id"), "text", "language")
    bundles = check_claims(for_check(extract.extract(statements, reference_date)[0], kb), kb, keep=True)[0].withColumnRenamed("statement_id", "declaration_id")
    edge = attribution.edge_columns()
    both = bundles.select("declaration_id", "position", "claim_type", "checkability", *edge).groupBy("declaration_id").agg(*extract.declared(), *attribution.judged())
    out, tasks = attribution.judgements(extract.with_declared(utterances, both))
    return out, bundles.select(*edge), tasks
