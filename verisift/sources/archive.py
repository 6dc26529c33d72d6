"""Content-addressed archive, evidence spans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import uuid5

#: Source families and file extensions by content type. Fixed values.
FAMILIES = ["knesset", "gov_il", "elections", "statements"]
EXTENSIONS = {"application/json": "json", "text/csv": "csv", "text/html": "html", "application/xml": "xml", "text/xml": "xml", "application/pdf": "pdf", "text/plain": "txt"}
URI = r"^s3://([a-z0-9][a-z0-9.-]*)/([a-z_]+)/(\d{4})/(\d{2})/(\d{2})/([0-9a-f]{64})\.([a-z0-9]+)$"


def extension(content_type: Column) -> Column:
    base = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, base), F.lit("bin"))


def archive_uri(family: Column, captured_at: Column, sha: Column, ext: Column, bucket: str = "archive", families: list[str] | None = None) -> Column:
    """s3://bucket/family/YYYY/MM/DD/sha.ext by UTC date; unknown families give null."""
    day = F.date_format(F.to_utc_timestamp(captured_at, F.current_timezone()), "yyyy/MM/dd")
    return F.when(family.isin(families or FAMILIES), F.concat_ws("", F.lit(f"s3://{bucket}/"), family, F.lit("/"), day, F.lit("/"), sha, F.lit("."), ext))


def parse_archive_uri(uri: Column, families: list[str] | None = None) -> Column:
    """struct(bucket, family, day, sha, ext, valid): strict pattern, known family, calendar date."""
    part = lambda i: F.regexp_extract(uri, URI, i)
    day = F.try_to_date(F.concat_ws("-", part(3), part(4), part(5)), "yyyy-MM-dd")
    ok = uri.rlike(URI) & part(2).isin(families or FAMILIES) & day.isNotNull()
    return F.struct(part(1).alias("bucket"), part(2).alias("family"), day.alias("day"), part(6).alias("sha"), part(7).alias("ext"), F.coalesce(ok, F.lit(False)).alias("valid"))


def archive(fetched: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fetched: content, content_type, family, source_url, captured_at, source_tier, seq.

    -> (answers: one row per fetched row with the archive row it stands on and ``created``, new archive rows).
    The first row of a hash in the batch writes it, unless the archive has it.
    """
    f = fetched.withColumn("content_sha256", F.sha2("content", 256))
    first = Window.partitionBy("content_sha256").orderBy("seq")
    f = f.withColumn("_first", F.row_number().over(first) == 1)
    uri = archive_uri(F.col("family"), F.col("captured_at"), F.col("content_sha256"), extension(F.col("content_type")))
    fresh = f.where("_first").join(existing.select("content_sha256"), "content_sha256", "left_anti").select(
        "content_sha256", uuid5(F.concat(F.lit("raw:"), F.col("content_sha256"))).alias("object_id"), "source_url", uri.alias("archive_uri"), "content_type",
        F.octet_length("content").cast("long").alias("byte_size"), "captured_at", "source_tier",
    )
    held = existing.select("content_sha256", F.col("archive_uri"), F.lit(True).alias("_old")).unionByName(fresh.select("content_sha256", "archive_uri", F.lit(False).alias("_old")))
    answers = f.drop("content").join(held, "content_sha256").withColumn("created", F.col("_first") & ~F.col("_old")).drop("_first", "_old")
    return answers, fresh


def write_payloads(fetched: DataFrame, fresh: DataFrame, path: str) -> None:
    """Lay the new payloads down, partitioned by family and day."""
    new = fetched.withColumn("content_sha256", F.sha2("content", 256)).join(fresh.select("content_sha256"), "content_sha256", "left_semi").dropDuplicates(["content_sha256"])
    new.withColumn("day", F.to_date("captured_at")).select("content_sha256", "content", "family", "day").write.mode("append").partitionBy("family", "day").parquet(path)


def build_span_index(documents: DataFrame) -> DataFrame:
    """One evidence span per document: its title (or '.'), offsets, lower-cased copy, tier 2 unless set."""
    text = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("."))
    return documents.select(
        uuid5(F.concat(F.lit("evidence_span:"), F.col("document_id"))).alias("span_id"), "document_id", F.coalesce("source_tier", F.lit(2)).alias("source_tier"), "source_type", "url", "archive_uri",
        text.alias("text"), F.lower(text).alias("normalized_text"), F.lit(0).alias("char_start"), F.length(text).alias("char_end"), "captured_at",
    )


def extract_spans(documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors (document_id, anchor): the first occurrence of a literal in the body, with offsets and a key over sha and offsets."""
    at = F.instr("body", F.col("anchor")) - 1
    hit = documents.join(anchors, "document_id").withColumn("char_start", at).where("char_start >= 0 and length(anchor) > 0")
    hit = hit.withColumn("char_end", F.col("char_start") + F.length("anchor"))
    key = uuid5(F.concat_ws(":", F.lit("span"), F.coalesce("content_sha256", F.sha2(F.col("body").cast("binary"), 256)), F.col("char_start").cast("string"), F.col("char_end").cast("string")))
    return hit.select(key.alias("span_id"), "document_id", F.col("anchor").alias("text"), "char_start", "char_end")


def write_statements(statements: DataFrame, claims: DataFrame, existing_statements: DataFrame, existing_claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append: keys that exist are left alone; a missing checkability is non_checkable."""
    new = statements.dropDuplicates(["statement_id"]).join(existing_statements.select("statement_id"), "statement_id", "left_anti")
    rows = claims.withColumn("checkability", F.coalesce("checkability", F.lit("non_checkable"))).dropDuplicates(["statement_id", "claim_id"])
    return new, rows.join(existing_claims.select("statement_id", "claim_id"), ["statement_id", "claim_id"], "left_anti")


def run_id(family: str, adapter: str, started) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{family}/{adapter}/{started}"))


def run_started(spark: SparkSession, family: str, adapter: str, started) -> DataFrame:
    """The row of a run that has begun."""
    row = (run_id(family, adapter, started), family, adapter, str(started))
    df = spark.createDataFrame([row], "run_id string, source_family string, adapter string, started_at string")
    return df.select("run_id", "source_family", "adapter", F.col("started_at").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("status"), F.create_map().cast("map<string,string>").alias("stats"))


def run_finished(runs: DataFrame, ident: str, stats: DataFrame, finished, failed: bool = False) -> DataFrame:
    """The table of runs with one run ended. stats (stat, value) are merged into its counters, a new value over an old one;
    a run that has ended already keeps its end."""
    new = F.map_from_entries(F.collect_list(F.struct(F.col("stat"), F.col("value").cast("string"))))
    open_ = (F.col("run_id") == ident) & (F.col("status") == "running")
    merged = lambda s: F.map_concat(F.map_filter("stats", lambda k, v: ~F.map_contains_key(s, k)), s)
    counters = stats.agg(new.alias("_s")).select(F.lit(ident).alias("run_id"), "_s")
    return runs.join(F.broadcast(counters), "run_id", "left").select(
        "run_id", "source_family", "adapter", "started_at", F.when(open_, F.lit(finished).cast("timestamp")).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(open_, "failed" if failed else "succeeded").otherwise(F.col("status")).alias("status"), F.when(open_, merged(F.col("_s"))).otherwise(F.col("stats")).alias("stats"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """Small aggregated reports as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
