"""Cutting lineage: intermediate tables that several branches of a plan read are written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_CHOSEN: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir. Where it is unset: below the warehouse, which all machines
    see; on one machine a new temporary folder, kept for the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        app = spark.sparkContext.applicationId
        if app not in _CHOSEN:
            local = spark.sparkContext.master.startswith("local")
            _CHOSEN[app] = tempfile.mkdtemp(prefix="checkpoints-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        named = _CHOSEN[app]
    return named.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


SPREAD_FROM, SPREAD_TO = 1 << 19, 256 << 20  # bytes


def spread(scan: DataFrame) -> DataFrame:
    """A small table that its files give in few parts (a row group is one part): its rows are dealt to all cores.

    The bounds keep the exchange small: tiny tables stay whole, and files of large ones give parts enough.
    """
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not SPREAD_FROM <= size <= SPREAD_TO:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    parts = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if parts >= 4 * cores else scan.repartition(2 * cores)


def dealt(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """Rows dealt by keys to so many tasks that each has about ``each`` of them, for steps whose time goes by rows and not by bytes."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table that several branches read, written once as Parquet: they read only the columns they need."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()
