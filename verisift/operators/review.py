"""The human-review queue as tables: tasks, actions, and how actions fold into task states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import entity_key
from ..plans.schemas import DOMAINS
from .resolve import relink

#: What an action makes of a task; resolved and escalated are final. Fixed values.
AFTER = {"approve": "resolved", "reject": "resolved", "relink": "resolved", "annotate": "open", "escalate": "escalated"}
FINAL = ["resolved", "escalated"]


def open_tasks(rows: DataFrame, kind: str, key: Column, payload: Column, priority: int = 0) -> DataFrame:
    if kind not in DOMAINS["task_kind"]:
        raise ValueError(f"unknown task kind {kind!r}")
    return rows.select(entity_key(f"review_task:{kind}", key).alias("task_id"), F.lit(kind).alias("kind"), F.lit("open").alias("status"), F.lit(priority).alias("priority"), payload.alias("payload"), F.lit(None).cast("string").alias("assigned_to"))


def conflict_tasks(verdicts: DataFrame) -> DataFrame:
    """Mixed verdicts with tier-1 facts."""
    rows = verdicts.where((F.col("status") == "mixed") & (F.col("n_tier1_any") >= 1))
    return open_tasks(rows, "conflict", F.col("claim_id"), F.to_json(F.struct("claim_id", "claim_type", "status", "n_tier1_any")), priority=10)


def pending(tasks: DataFrame, limit: int | None = None, kind: str | None = None) -> DataFrame:
    """Open and claimed tasks, most urgent first, then by id."""
    out = tasks.where(F.col("status").isin("open", "claimed"))
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    out = out.orderBy(F.col("priority").desc(), "task_id")
    return out.limit(limit) if limit else out


def find(tasks: DataFrame, task_id: str) -> DataFrame:
    return tasks.where(F.col("task_id") == task_id)


def known(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action").isin(list(AFTER)))


def after(action: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in AFTER.items() for x in kv]), action)


def fold(tasks: DataFrame, actions: DataFrame) -> DataFrame:
    """The state of every task after its actions in action_seq order: the first final action wins, an annotation reopens a
    claimed task, later actions change nothing. The last actor up to then is the assignee."""
    a = known(actions).withColumn("_to", after(F.col("action")))
    end = a.groupBy("task_id").agg(F.min(F.when(F.col("_to").isin(FINAL), F.col("action_seq"))).alias("_end"))
    live = a.join(end, "task_id").where(F.col("_end").isNull() | (F.col("action_seq") <= F.col("_end")))
    per = live.groupBy("task_id").agg(F.max_by("_to", "action_seq").alias("_status"), F.max_by("actor", F.when(F.col("actor").isNotNull(), F.col("action_seq"))).alias("_actor"))
    out = tasks.join(per, "task_id", "left")
    done = F.col("status").isin(FINAL)
    return out.withColumns({"_s": F.when(done | F.col("_status").isNull(), F.col("status")).otherwise(F.col("_status")), "_a": F.when(done, F.col("assigned_to")).otherwise(F.coalesce("_actor", "assigned_to"))}).withColumns({"status": F.col("_s"), "assigned_to": F.col("_a")}).drop("_s", "_a", "_status", "_actor")


def audit(tasks: DataFrame, actions: DataFrame) -> DataFrame:
    """One row for each known action on a known task; a rejected verdict keeps the machine's verdict beside it.

    The rejection is marked only if it was applied, that is, if no final action came before it.
    """
    a = known(actions).join(tasks.select("task_id", "kind", F.col("status").alias("_was"), "payload"), "task_id").withColumn("_to", after(F.col("action")))
    end = a.groupBy("task_id").agg(F.min(F.when(F.col("_to").isin(FINAL), F.col("action_seq"))).alias("_end"))
    a = a.join(end, "task_id")
    applied = ~F.col("_was").isin(FINAL) & (F.col("_end").isNull() | (F.col("action_seq") <= F.col("_end")))
    override = applied & (F.col("action") == "reject") & (F.col("kind") == "verdict")
    return a.select(
        entity_key("review_action", F.concat_ws(":", "task_id", F.col("action_seq").cast("string"))).alias("action_id"), "task_id", "action_seq", "actor", "action", "notes",
        override.alias("verdict_reviewer_override"), F.when(override, F.get_json_object("payload", "$.machine_verdict")).alias("original_machine"),
    )


def confirm_evidence(confirmations: DataFrame) -> DataFrame:
    """(task_id, actor, span_ids, action_seq) -> annotate actions; empty lists are ignored."""
    return confirmations.where(F.size("span_ids") > 0).select("task_id", "actor", F.lit("annotate").alias("action"), F.to_json(F.struct(F.col("span_ids").alias("confirmed_span_ids"))).alias("notes"), "action_seq")


def relink_by_task(candidates: DataFrame, tasks: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-pointed candidates, and the tasks resolved by that."""
    return relink(candidates, tasks, actions), fold(tasks, actions)
