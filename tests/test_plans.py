"""Plans: what is read once is computed once, and small tables of one row group use all cores."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from verisift.operators import extract
from verisift.plans import materialise


def test_rules_are_matched_once(spark, tmp_path):
    """No filter or join condition inferred from the exploded matches."""
    spark.createDataFrame([("a", "Ann Lee voted for the clean air bill in 2020.", "en")], "statement_id string, text string, language string").write.parquet(f"{tmp_path}/s")
    s = spark.read.parquet(f"{tmp_path}/s")
    names = spark.range(3).select(F.col("id").cast("string").alias("statement_id"))
    claims, _ = extract.extract(s.join(names, "statement_id", "left"), F.to_date(F.lit("2023-06-01")))
    plan = claims.select("claim_id", "claim_type")._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.split("\n") if "aggregate(" in x]
    assert len(lines) == 1 and lines[0].lstrip(" +-:").startswith("Project")
    assert claims.count() == 1


def test_spread(spark, tmp_path, monkeypatch):
    pq.write_table(pa.table({"x": [f"row {i} {i * 7919 % 1000003}" for i in range(60_000)]}), f"{tmp_path}/one.parquet")
    pq.write_table(pa.table({"x": ["a"]}), f"{tmp_path}/tiny.parquet")
    one, tiny = spark.read.parquet(f"{tmp_path}/one.parquet"), spark.read.parquet(f"{tmp_path}/tiny.parquet")
    cores = spark.sparkContext.defaultParallelism
    dealt = materialise.spread(one)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 2 * cores and dealt.count() == 60_000
    assert materialise.spread(tiny) is tiny
    monkeypatch.setattr(materialise, "SPREAD_TO", 1)
    assert materialise.spread(one) is one
