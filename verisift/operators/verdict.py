"""Verdicts: abstention, comparison by claim type, review flag, decision trace, provenance bundle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schemas import ABSTAIN_BELOW, REVIEW_BELOW
from .rank import AXES, overall

#: A decision trace entry.
REASON = "struct<kind:string,reason:string,source:string,count:bigint,expected:string,observed:string>"


def reason(kind: str, why: str | Column | None = None, source: str | None = None, count: Column | None = None, expected: Column | None = None, observed: Column | None = None) -> Column:
    text = lambda x: F.lit(None).cast("string") if x is None else F.lit(x) if isinstance(x, str) else x.cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), text(why).alias("reason"), text(source).alias("source"), (F.lit(None) if count is None else count).cast("long").alias("count"), text(expected).alias("expected"), text(observed).alias("observed")
    )


def best(top: int) -> Column:
    """Aggregate: the first ``top`` pieces of evidence with their scores, in order."""
    return F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct(*TOP))), lambda a, b: a["rank"] - b["rank"])


def facts_by_claim(ranked: DataFrame, top: int = 0) -> DataFrame:
    """What the comparison needs of a claim's evidence, the best value of each axis and (if top is given) the top evidence, in one aggregate by claim.

    The sets are bounded by the retrieval's limit for a claim.
    """
    own = (F.col("kind") == "fact") & (F.col("evidence_type") == F.col("claim_type"))
    return ranked.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n_evidence"),
        F.count_if(own).alias("n_facts"),
        F.count_if(F.col("kind") == "text").alias("n_text"),
        F.count_if(own & (F.col("source_tier") == 1)).alias("n_tier1"),
        F.count_if((F.col("kind") == "fact") & (F.col("source_tier") == 1)).alias("n_tier1_any"),
        F.count_if(own & F.coalesce(F.col("presence") == "present", F.lit(False))).alias("n_present"),
        F.count_if(own & F.col("vote_value").isNull()).alias("n_no_value"),
        F.array_sort(F.collect_set(F.when(own, F.col("vote_value")))).alias("recorded_values"),
        F.collect_set(F.when(own & (F.col("evidence_type") == "election_result"), F.struct("seats_won", "passed_threshold"))).alias("results"),
        F.collect_set(F.when(own, F.try_element_at("node_ids", F.lit("government_decision_id")))).alias("decision_ids"),
        *[F.max(a).alias(a) for a in AXES],
        *([best(top).alias("top_evidence")] if top else []),
    )


def decide(claims: DataFrame, ranked: DataFrame, top: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """claims: claim_id, claim_type, checkability, expected_vote_value, expected_seats, expect_passed_threshold, government_decision_id.

    -> one row a claim: status, confidence struct, needs_human_review, reasons, the evidence counts, the claim's columns named in
    carry, and top_evidence if top is given.
    """
    c = claims.select(
        "claim_id", "claim_type", "checkability", "expected_vote_value", F.col("expected_seats").cast("int").alias("expected_seats"), F.col("expect_passed_threshold").cast("boolean").alias("expect_passed_threshold"),
        F.col("government_decision_id").alias("expected_decision_id"), *carry,
    )
    facts = facts_by_claim(ranked, top)
    j = c.join(facts, "claim_id", "left").withColumn("overall", overall())
    seats = lambda r: F.col("expected_seats").isNull() | F.coalesce(r.seats_won == F.col("expected_seats"), F.lit(False))
    passed = lambda r: F.col("expect_passed_threshold").isNull() | F.coalesce(r.passed_threshold == F.col("expect_passed_threshold"), F.lit(False))
    j = j.withColumn("n_election_match", F.size(F.filter("results", lambda r: seats(r) & passed(r))))
    j = j.withColumn("n_decision_match", F.when(F.col("expected_decision_id").isNull(), F.col("n_facts")).otherwise(F.array_contains("decision_ids", F.col("expected_decision_id")).cast("int")))
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    is_ = lambda *t: F.col("claim_type").isin(*t)
    status_of = lambda s, *r: F.struct(F.lit(s).alias("status"), F.array(*r).cast(f"array<{REASON}>").alias("reasons"))
    want, got = F.col("expected_vote_value"), F.coalesce("recorded_values", F.array().cast("array<string>"))
    kinds = F.size(got) + (n("n_no_value") > 0).cast("int")
    observed = F.array_join(got, ",")

    vote = (
        F.when(n("n_facts") == 0, status_of("insufficient_evidence", reason("abstain", "no_graph_vote_record")))
        .when(want.isNull(), status_of("supported", reason("support", "any_vote_recorded")))
        .when((kinds == 1) & F.array_contains(got, want), status_of("supported", reason("support", F.concat(F.lit("matches "), want))))
        .when(F.array_contains(got, want), status_of("mixed", reason("mixed", observed=observed)))
        .otherwise(status_of("contradicted", reason("contradict", expected=want, observed=observed)))
    )
    election = (
        F.when(n("n_facts") == 0, status_of("insufficient_evidence", reason("abstain", "no_election_graph_hit")))
        .when(n("n_election_match") > 0, status_of("supported", reason("support", source="graph", count=n("n_election_match"))))
        .otherwise(status_of("contradicted", reason("contradict", expected=F.concat_ws(",", F.col("expected_seats").cast("string"), F.col("expect_passed_threshold").cast("string")), count=n("n_facts"))))
    )
    decision = (
        F.when(n("n_facts") == 0, status_of("insufficient_evidence", reason("abstain", "no_gov_decision_graph_hit")))
        .when(n("n_decision_match") > 0, status_of("supported", reason("support", source="graph", count=n("n_decision_match"))))
        .otherwise(status_of("contradicted", reason("contradict", "decision_id_mismatch", expected=F.col("expected_decision_id"), count=n("n_facts"))))
    )
    record = (
        F.when(n("n_facts") > 0, status_of("supported", reason("support", source="graph", count=n("n_facts"))))
        .when(n("n_text") > 0, status_of("supported", reason("support", source="lexical", count=n("n_text"))))
        .otherwise(status_of("insufficient_evidence", reason("abstain", "no_graph_or_lex_support")))
    )
    attendance = (
        F.when(n("n_facts") == 0, status_of("insufficient_evidence", reason("abstain", "no_attendance_graph_hit")))
        .when(n("n_present") > 0, status_of("supported", reason("support", count=n("n_present"))))
        .otherwise(status_of("contradicted", reason("contradict", "only_absent_sessions")))
    )
    statement = (
        F.when(n("n_text") >= 2, status_of("supported", reason("support", source="lexical_multi")))
        .when(n("n_text") == 1, status_of("mixed", reason("mixed", source="lexical_single")))
        .otherwise(status_of("insufficient_evidence", reason("abstain", "no_corroboration")))
    )
    compared = (
        F.when(is_("vote_cast"), vote).when(is_("election_result"), election).when(is_("government_decision"), decision)
        .when(is_("bill_sponsorship", "office_held", "committee_membership"), record).when(is_("committee_attendance"), attendance).otherwise(statement)
    )
    open_ = F.col("checkability") == "checkable"
    verdict = (
        F.when(~F.coalesce(open_, F.lit(False)), status_of("non_checkable", reason("abstain", F.concat(F.lit("checkability:"), F.coalesce("checkability", F.lit(""))))))
        .when(n("n_evidence") == 0, status_of("insufficient_evidence", reason("abstain", "no_evidence")))
        .when(F.col("overall") < ABSTAIN_BELOW, status_of("insufficient_evidence", reason("abstain", "low_confidence", observed=F.col("overall"))))
        .otherwise(compared)
    )
    zero = ~F.coalesce(open_, F.lit(False)) | (n("n_evidence") == 0)
    out = j.withColumn("v", verdict).withColumns({"status": F.col("v.status"), "reasons": F.col("v.reasons")})
    conf = {a: F.when(zero, 0.0).otherwise(F.col(a)) for a in [*AXES, "overall"]}
    out = out.withColumns(conf)
    tested = open_ & (n("n_evidence") > 0)
    review = (
        F.when(~F.coalesce(open_, F.lit(False)), F.coalesce(F.col("checkability") == "insufficient_entity_resolution", F.lit(False)))
        .when(~tested | (F.col("overall") < ABSTAIN_BELOW), True)
        .otherwise((F.col("overall") < REVIEW_BELOW) | (F.col("status") == "mixed") | ((F.col("status") == "contradicted") & (n("n_facts") > 0) & (n("n_tier1") == 0)))
    )
    vector = F.struct(F.col("source_tier_score").alias("source_authority"), *[F.col(a) for a in AXES[1:]], F.col("overall"))
    counts = [n(x).alias(x) for x in ("n_evidence", "n_facts", "n_text", "n_tier1_any")]
    evidence = [F.coalesce("top_evidence", F.array().cast(facts.schema["top_evidence"].dataType)).alias("top_evidence")] if top else []
    return out.select("claim_id", "claim_type", "checkability", "status", vector.alias("confidence"), review.alias("needs_human_review"), "reasons", *counts, *carry, *evidence)


TOP = ["rank", "kind", "evidence_type", "node_ids", "span_id", "document_id", "source_tier", *AXES, "overall"]


def bundle(verdicts: DataFrame, ranked: DataFrame, notes: DataFrame | None = None, top: int = 5) -> DataFrame:
    """Verdict and its top evidence with scores, in order; notes (claim_id, note) reach only rows for review and change nothing else."""
    per = ranked.where(F.col("rank") <= top).groupBy("claim_id").agg(best(top).alias("top_evidence"))
    empty = F.array().cast(per.schema["top_evidence"].dataType)
    return with_notes(verdicts.join(per, "claim_id", "left").withColumn("top_evidence", F.coalesce("top_evidence", empty)), notes)


def bundles(claims: DataFrame, ranked: DataFrame, notes: DataFrame | None = None, top: int = 5, carry: Sequence[str] = ()) -> DataFrame:
    """What ``bundle`` makes of ``decide``, in one aggregate: the evidence is computed once and moved once."""
    return with_notes(decide(claims, ranked, top, carry), notes)


def with_notes(out: DataFrame, notes: DataFrame | None) -> DataFrame:
    if notes is None:
        return out.withColumn("note", F.lit(None).cast("string"))
    return out.join(notes.select("claim_id", F.col("note").alias("_n")), "claim_id", "left").withColumn("note", F.when(F.col("needs_human_review"), F.col("_n"))).drop("_n")
