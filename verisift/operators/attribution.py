"""Attribution of declarations to records: relation, confidence band, worst relation, target and spans of each claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import entity_key, is_uuid

#: Verdict status -> relation, and relations from worst to best. Fixed values.
RELATION = {"supported": "supported_by", "contradicted": "contradicted_by", "mixed": "overstates", "insufficient_evidence": "not_checkable_against_record", "non_checkable": "not_checkable_against_record"}
WORST_FIRST = ["contradicted_by", "entity_ambiguous", "time_scope_mismatch", "not_checkable_against_record", "overstates", "underspecifies", "supported_by"]
#: Claim type -> target kind (others: AtomicClaim) and where its id stands. Fixed values.
TARGET = {"vote_cast": "VoteEvent", "bill_sponsorship": "Bill", "office_held": "PositionTerm", "election_result": "ElectionResult"}
TARGET_KEYS = {"vote_cast": ["vote_event_id"], "bill_sponsorship": ["bill_id"], "office_held": ["position_term_id", "office_id"], "election_result": ["election_result_id"]}
#: Relations that open a review task. Fixed values.
TO_REVIEW = ["contradicted_by", "entity_ambiguous", "time_scope_mismatch", "overstates", "underspecifies"]
BANDS = [("high", 0.8), ("medium", 0.6), ("low", 0.45)]


def relation(status: Column, checkability: Column, reasons: Column, text_hits: Column) -> Column:
    base = F.lit("not_checkable_against_record")
    for s, r in RELATION.items():
        base = F.when(status == s, r).otherwise(base)
    late = F.exists(reasons, lambda x: F.coalesce(x.reason.contains("time_scope"), F.lit(False)))
    return (
        F.when((status == "non_checkable") & (checkability == "insufficient_entity_resolution"), "entity_ambiguous")
        .when((status == "non_checkable") & (checkability == "insufficient_time_scope"), "time_scope_mismatch")
        .when((status == "contradicted") & late, "time_scope_mismatch")
        .when((status == "mixed") & (text_hits == 1), "underspecifies")
        .otherwise(base)
    )


def band(overall: Column) -> Column:
    out = F.lit("uncertain")
    for name, least in reversed(BANDS):
        out = F.when(overall >= least, name).otherwise(out)
    return out


def severity(rel: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(r) for r in WORST_FIRST]), rel), F.lit(0).cast("long"))


def worst(rel: Column) -> Column:
    """Aggregate: the most severe known relation; none: not_checkable_against_record."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(r) for r in WORST_FIRST]), F.min(severity(rel)).cast("int")), F.lit("not_checkable_against_record"))


def target_type(claim_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TARGET.items() for x in kv]), claim_type), F.lit("AtomicClaim"))


def target_id(claim_type: Column, top: Column, fallback: Column) -> Column:
    """The first fact of the claim's own type that holds a valid id under the type's keys, in key order; else the claim."""
    out = F.lit(None).cast("string")
    for t, keys in TARGET_KEYS.items():
        ids = F.flatten(F.transform(F.filter(top, _own_fact(t)), _ids(keys)))
        out = F.when(claim_type == t, F.try_element_at(F.filter(ids, is_uuid), F.lit(1))).otherwise(out)
    return F.coalesce(out, fallback)


def _own_fact(claim_type: str):
    return lambda e: (e.kind == "fact") & (e.evidence_type == claim_type)


def _ids(keys: list[str]):
    return lambda e: F.array(*[F.try_element_at(e.node_ids, F.lit(k)) for k in keys])


def span_ids(top: Column) -> Column:
    """Valid span ids of the top evidence, in order, once each."""
    each = F.transform(top, lambda e: F.array(F.try_element_at(e.node_ids, F.lit("span_id")), F.when(e.kind == "text", e.span_id)))
    return F.array_distinct(F.filter(F.flatten(each), is_uuid))


def edges(bundles: DataFrame, owners: DataFrame) -> DataFrame:
    """owners: claim_id -> declaration_id. One attribution edge a claim."""
    return bundles.join(owners.select("claim_id", "declaration_id"), "claim_id").select(*edge_columns())


def edge_columns() -> list[Column]:
    """The edge of each bundle that has its declaration_id."""
    hits = F.size(F.filter("top_evidence", lambda e: e.kind == "text"))
    return [
        entity_key("attribution", F.concat_ws(":", "declaration_id", "claim_id")).alias("attribution_id"), F.col("declaration_id").alias("from_declaration_id"), "claim_id",
        target_id(F.col("claim_type"), F.col("top_evidence"), F.col("claim_id")).alias("to_object_id"), target_type(F.col("claim_type")).alias("to_object_type"),
        relation(F.col("status"), F.col("checkability"), F.col("reasons"), hits).alias("relation_type"), span_ids(F.col("top_evidence")).alias("evidence_span_ids"), band(F.col("confidence.overall")).alias("confidence_band"),
        F.when(F.col("needs_human_review"), "needs_human_review").otherwise("pending").alias("review_status"),
    ]


def judged() -> list[Column]:
    """Aggregates over a declaration's edges."""
    return [worst(F.col("relation_type")).alias("overall_relation"), F.array_sort(F.collect_list(F.struct("claim_id", "attribution_id", "relation_type", "to_object_type", "to_object_id", "confidence_band"))).alias("edges")]


def judge(declarations: DataFrame, attribution: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(declarations with overall_relation, review tasks with their payload)."""
    per = attribution.groupBy(F.col("from_declaration_id").alias("declaration_id")).agg(*judged())
    return judgements(declarations.join(per, "declaration_id", "left"))


def judgements(declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of declarations that have what ``judged`` gives, or nulls."""
    out = declarations.withColumn("overall_relation", F.coalesce("overall_relation", F.lit("not_checkable_against_record")))
    payload = F.to_json(F.struct("declaration_id", "overall_relation", F.col("edges").alias("attribution_edges"), "derived_atomic_claim_ids", F.substring("text", 1, 500).alias("utterance_text")))
    tasks = out.where(F.col("overall_relation").isin(TO_REVIEW)).select(
        entity_key("review_task:declaration", F.col("declaration_id")).alias("task_id"), F.lit("declaration").alias("kind"), F.lit("open").alias("status"), F.lit(1).alias("priority"), payload.alias("payload")
    )
    return out.drop("edges"), tasks
