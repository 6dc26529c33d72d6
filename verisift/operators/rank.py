"""Evidence ranking on five axes and the confidence vector, for all claims at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schemas import WEIGHTS

AXES = list(WEIGHTS)


def tier_score(tier: Column) -> Column:
    return F.when(tier == 1, 1.0).when(tier == 2, 0.6).when(tier == 3, 0.3).otherwise(0.1)


def directness(fact: Column, evidence_type: Column, claim_type: Column, text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(fact, F.when(evidence_type == claim_type, 1.0).otherwise(0.6)).when(t == "", 0.0).when(F.length(t) < 160, 0.75).otherwise(0.5)


def temporal(fact: Column, occurred: Column, captured: Column, start: Column, end: Column) -> Column:
    """Scopes without any bound still are scopes; a claim without a scope column value (has_scope false) scores 0.5."""
    out = lambda at: F.coalesce(start.isNotNull() & (at < start), F.lit(False)) | F.coalesce(end.isNotNull() & (at > end), F.lit(False))
    return F.when(
        F.coalesce(F.col("has_scope"), F.lit(True)),
        F.when(fact, F.when(occurred.isNull(), 0.6).when(out(occurred), 0.2).otherwise(1.0)).otherwise(F.when(captured.isNull(), 0.5).when(out(captured), 0.4).otherwise(0.8)),
    ).otherwise(0.5)


def entity(fact: Column, node_ids: Column, resolved: Column) -> Column:
    """resolved: map of slot -> id."""
    hits = F.size(F.filter(F.map_entries(resolved), lambda e: F.coalesce(F.try_element_at(node_ids, e.key) == e.value, F.lit(False))))
    none = resolved.isNull() | (F.size(resolved) == 0)
    return F.when(none, 0.5).when(~fact, 0.6).when(hits == 0, 0.2).otherwise(F.least(F.lit(1.0), 0.5 + 0.25 * hits))


def cross_source(documents: Column) -> Column:
    return F.when(documents <= 1, 0.3).when(documents == 2, 0.7).otherwise(1.0)


def stable_key() -> Column:
    ids = F.array_join(F.array_sort(F.map_values("node_ids")), ":")
    return F.when(F.col("kind") == "fact", F.concat(F.lit("g:"), ids)).otherwise(F.concat(F.lit("l:"), F.coalesce("span_id", F.lit(""))))


def overall() -> Column:
    total = F.lit(0.0)
    for axis, w in WEIGHTS.items():
        total = total + F.col(axis) * w
    return F.round(total, 4)


def score(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """claims: claim_id, claim_type, time_start, time_end, resolved_ids (map), has_scope (optional).

    Adds the five axes, overall and rank. The distinct documents of a claim are counted over its own rows (a window on
    claim_id, which the rank needs anyway), so there is one shuffle by claim.
    """
    c = claims.select("claim_id", "claim_type", "time_start", "time_end", "resolved_ids", *(["has_scope"] if "has_scope" in claims.columns else []))
    e = evidence.join(c, "claim_id")
    if "has_scope" not in e.columns:
        e = e.withColumn("has_scope", F.lit(True))
    fact = F.col("kind") == "fact"
    docs = F.size(F.array_distinct(F.flatten(F.collect_set("source_document_ids").over(Window.partitionBy("claim_id")))))
    e = e.withColumns(
        {
            "source_tier_score": tier_score(F.col("source_tier")),
            "directness": directness(fact, F.col("evidence_type"), F.col("claim_type"), F.col("text")),
            "temporal_alignment": temporal(fact, F.col("occurred_at"), F.col("captured_at"), F.col("time_start"), F.col("time_end")),
            "entity_resolution": entity(fact, F.col("node_ids"), F.col("resolved_ids")),
            "cross_source_consistency": cross_source(docs),
            "stable_key": stable_key(),
        }
    ).withColumn("overall", overall())
    place = Window.partitionBy("claim_id").orderBy(F.col("overall").desc(), "stable_key", F.col("occurred_at").desc_nulls_last())
    return e.withColumn("rank", F.row_number().over(place))


def confidence(ranked: DataFrame) -> DataFrame:
    """Per claim the best value of each axis and their weighted sum."""
    best = ranked.groupBy("claim_id").agg(*[F.max(a).alias(a) for a in AXES])
    return best.withColumn("overall", overall())
