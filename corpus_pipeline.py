"""A corpus pipeline: STAGES run in order, each written as Parquet and read again as the next one's documents.

Each stage calls one operator of ``verisift.llm`` on all rows its predecessor kept. Shuffling into shards comes last, so
its rows carry shard and slot. The last two stages are seeded draws, so no SQL gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm import decontamination, mixing, ngram_join, sharding, toxicity
from verisift.llm.common import table
from verisift.llm.queries import SHARDS, held_out
from verisift.plans.materialise import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above their language's threshold go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).where(~F.col("toxic_flag")).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows to a twentieth of their words or more go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeated(mixing.mix(docs, seed=6), docs.columns)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into shards of equal size."""
    return sharding.shard(docs, SHARDS, seed=1)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_rows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, docs = shared_folder(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
