"""Evaluation against gold rows, quality gates, freshness of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cadence_seconds

ABSTAIN = ["insufficient_evidence", "non_checkable"]
#: Gates: metric -> least value. Fixed values.
GATES = {"rows": 25.0, "f1_verdict": 1.0, "f1_claim_typing": 1.0, "abstention_correctness": 1.0}


def row_metrics(gold: DataFrame, results: DataFrame, live: bool = False) -> DataFrame:
    """gold: id, expected_claim_types, expected_verdict, expected_verdict_live; results: id, claim_type, status, n_evidence (one row a claim)."""
    per = results.groupBy("id").agg(
        F.collect_set("claim_type").alias("types"), F.collect_list("status").alias("statuses"), F.bool_and(F.when(~F.col("status").isin(ABSTAIN), F.col("n_evidence") > 0)).alias("provenance_complete")
    )
    want = F.coalesce("expected_verdict_live", "expected_verdict") if live else F.col("expected_verdict")
    g = gold.withColumn("_want", want).join(per, "id", "left")
    types, wanted = F.coalesce("types", F.array().cast("array<string>")), F.array_distinct("expected_claim_types")
    both, asked = F.size(F.array_intersect(types, wanted)), F.coalesce(F.size(wanted), F.lit(-1)) > 0
    statuses = F.coalesce("statuses", F.array().cast("array<string>"))
    return g.select(
        "id",
        F.when(asked, F.when(F.size(types) == 0, 0.0).otherwise(both / F.size(types))).alias("precision"),
        F.when(asked, both / F.size(wanted)).alias("recall"),
        F.when(F.col("_want").isNotNull() & (F.size(statuses) > 0), F.forall(statuses, lambda s: s == F.col("_want"))).alias("verdict_match"),
        "provenance_complete", F.size(statuses).alias("n_verdicts"), F.size(F.filter(statuses, lambda s: s.isin(ABSTAIN))).alias("n_abstain"),
    )


def rate(hit: Column, default: float) -> Column:
    return F.coalesce(F.avg(hit.cast("double")), F.lit(default))


def aggregate(rows: DataFrame) -> DataFrame:
    """One row of metrics."""
    p, r = F.col("precision"), F.col("recall")
    only = F.col("verdict_match").isNotNull() & (F.col("n_verdicts") > 0) & (F.col("n_abstain") == F.col("n_verdicts"))
    return rows.agg(
        F.count(F.lit(1)).cast("double").alias("rows"), rate(p, 0.0).alias("mean_claim_typing_precision"), rate(r, 0.0).alias("mean_claim_typing_recall"),
        F.coalesce(F.avg(F.when(p + r > 0, 2 * p * r / (p + r))), F.lit(0.0)).alias("f1_claim_typing"), rate(F.col("verdict_match"), 0.0).alias("f1_verdict"),
        F.coalesce(F.sum("n_abstain") / F.nullif(F.sum("n_verdicts"), F.lit(0).cast("long")), F.lit(0.0)).alias("abstention_rate"), rate(F.col("provenance_complete"), 1.0).alias("provenance_completeness"),
        rate(F.when(only, F.col("verdict_match")), 1.0).alias("abstention_correctness"),
    )


def failed_gates(metrics: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    """(gate, value, least) of every gate that is not met."""
    rows = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("least")) for k, v in (gates or GATES).items()]
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*").where("value < least")


def freshness(manifests: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Last successful run of every manifest, its age, and whether it is older than two cadences; never run: a note."""
    last = runs.where("status = 'succeeded'").groupBy(F.col("source_family").alias("family"), "adapter").agg(F.max("finished_at").alias("last_run"))
    m = manifests.select("family", "adapter", "cadence_cron", cadence_seconds(F.col("cadence_cron")).alias("interval_s")).join(last, ["family", "adapter"], "left")
    age = F.timestamp_diff("SECOND", F.col("last_run"), now)
    return m.select("family", "adapter", "interval_s", "last_run", age.alias("age_s"), F.coalesce(age > 2 * F.col("interval_s"), F.lit(False)).alias("stale"), F.when(F.col("last_run").isNull(), "never run").alias("note"))
