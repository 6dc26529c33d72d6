"""Checks over tables: keys, domains, schemas, provenance, load counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rank import AXES


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def schema_differences(df: DataFrame, contract: T.StructType) -> list[str]:
    """Missing, unknown and differently typed columns (nothing if the table conforms)."""
    have, want = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (df.schema, contract))
    out = [f"missing {c}" for c in want if c not in have] + [f"unknown {c}" for c in have if c not in want]
    return out + [f"{c}: {have[c]} is not {want[c]}" for c in want if c in have and have[c] != want[c]]


def domain_violations(df: DataFrame, key: str, domains: dict[str, list], ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(key, column, value) of every value outside its domain or range; nulls pass."""
    tests = [F.when(~F.col(c).isin(values), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, values in domains.items()]
    tests += [F.when(~F.col(c).between(lo, hi), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, (lo, hi) in (ranges or {}).items()]
    return df.select(key, F.explode(F.array_compact(F.array(*tests))).alias("v")).select(key, "v.*")


def without_evidence(bundles: DataFrame, abstaining: tuple[str, ...] = ("insufficient_evidence", "non_checkable")) -> DataFrame:
    """Verdicts that decide without any evidence."""
    return bundles.where(~F.col("status").isin(*abstaining) & (F.size("top_evidence") == 0)).select("claim_id", "status")


def without_archive_uri(documents: DataFrame) -> DataFrame:
    return documents.where(F.coalesce(F.trim("archive_uri"), F.lit("")) == "").select("document_id")


def load_report(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """counts (label, n) against expected (label): label, n, verdict (ok, missing, extra)."""
    got = counts.where("n > 0")
    j = got.join(expected.select("label", F.lit(True).alias("_e")), "label", "full_outer")
    return j.select("label", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("ok").alias("verdict"))


def count_labels(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def confidence_violations(verdicts: DataFrame) -> DataFrame:
    names = ["source_authority", *AXES[1:], "overall"]
    flat = verdicts.select("claim_id", *[F.col(f"confidence.{n}").alias(n) for n in names])
    return domain_violations(flat, "claim_id", {}, {n: (0.0, 1.0) for n in names})
