"""Scans of landed raw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_tags


def read_paged_json(spark: SparkSession, path: str, row: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Pages ``{value: [...], nextLink, count}`` in either key style -> (rows, bad pages: file and reason)."""
    page = T.StructType([T.StructField("value", T.ArrayType(row)), *[T.StructField(k, T.StringType()) for k in ("odata.nextLink", "@odata.nextLink", "odata.count", "@odata.count", "_corrupt")]])
    pages = spark.read.schema(page).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.col("_metadata.file_path"))
    bad = pages.where(F.col("value").isNull()).select("file", F.when(F.col("_corrupt").isNotNull(), "not json").otherwise("no value").alias("reason"))
    meta = [F.coalesce(F.col(f"`odata.{k}`"), F.col(f"`@odata.{k}`")).alias(n) for k, n in (("nextLink", "next_link"), ("count", "page_count"))]
    rows = pages.where(F.col("value").isNotNull()).select("file", *meta, F.posexplode("value").alias("row_seq", "r"))
    return rows.select("file", "next_link", "page_count", "row_seq", "r.*"), bad


def read_csv_dump(spark: SparkSession, path: str) -> DataFrame:
    """Header kept as it is (without a byte-order mark), every cell a string."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


SEARCH = T.StructType(
    [
        T.StructField("search_counts", T.StructType([T.StructField("_current", T.StructType([T.StructField("total_overall", T.LongType())]))])),
        T.StructField(
            "search_results",
            T.ArrayType(T.StructType([T.StructField("source", T.StructType([T.StructField(k, T.StringType()) for k in ("id", "title", "text", "procedure_number_str", "government", "publish_date", "office", "policy_type", "url_id")]))])),
        ),
    ]
)
#: Rows of this policy type are decisions. Fixed value.
DECISIONS = "החלטות"


def read_search_hits(spark: SparkSession, path: str) -> DataFrame:
    """Decision rows of search pages, with each page's overall hit total (0 if missing)."""
    pages = spark.read.schema(SEARCH).option("multiLine", True).json(path)
    total = F.coalesce(F.col("search_counts._current.total_overall"), F.lit(0)).alias("total_overall")
    hits = pages.select(total, F.explode("search_results").alias("h")).select("total_overall", "h.source.*")
    return hits.where(F.col("policy_type").contains(DECISIONS) & F.col("id").isNotNull() & (F.length(F.trim("title")) > 0))


#: Where result pages keep their numbers. Fixed values.
SUMMARY = r'(?s)class="ResultsSummaryTable".*?<tr>\s*<th.*?</tr>\s*<tr>(.*?)</tr>'
NUMBER_CELL = r"<td[^>]*>\s*([\d,\.%]+)\s*</td>"
BODY, CELL, FLOAT_DIV = r"(?s)<tbody>(.*?)</tbody>", r"(?s)<td[^>]*>(.*?)</td>", r'class="FloatDir">\s*([\d,]+)\s*<'


def extract_result_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per result line of every page, with the page's totals; the pages' other columns pass through."""
    nums = F.transform(F.regexp_extract_all(F.regexp_extract(html, SUMMARY, 1), F.lit(NUMBER_CELL), F.lit(1)), lambda c: F.regexp_replace(c, "[,%]", ""))
    keep = [c for c in pages.columns if c != html]
    p = pages.withColumn("_n", nums)
    total = lambda i: F.coalesce(F.try_element_at(F.col("_n"), F.lit(i)).try_cast("long"), F.lit(0))
    p = p.withColumns({"eligible_voters": total(1), "votes_cast": total(2), "valid_votes": total(4), "invalid_votes": total(5)})
    lines = p.withColumn("_tr", F.explode_outer(F.split(F.regexp_extract(html, BODY, 1), "<tr>"))).where(F.col("_tr").contains('scope="row"'))
    lines = lines.withColumn("_td", F.regexp_extract_all("_tr", F.lit(CELL), F.lit(1))).where(F.size("_td") >= 4)
    votes = F.regexp_replace(F.regexp_extract(F.element_at("_td", -1), FLOAT_DIV, 1), ",", "").try_cast("long")
    cell = lambda i: strip_tags(F.element_at("_td", i))
    out = lines.select(
        *keep, "eligible_voters", "votes_cast", "valid_votes", "invalid_votes",
        cell(1).alias("list_name"), cell(2).alias("ballot_letters"), cell(3).try_cast("int").alias("seats_won"), cell(4).alias("vote_share_pct"), F.coalesce(votes, F.lit(0)).alias("votes"),
    )
    return out.where((F.col("list_name") != "") & F.col("seats_won").isNotNull())


def load_lookup(df: DataFrame, key: str, value: str, sequence: Column) -> DataFrame:
    """(key, value) with blanks dropped; the last of duplicate keys wins."""
    full = df.where((F.trim(F.col(key).cast("string")) != "") & (F.trim(F.col(value).cast("string")) != ""))
    return full.groupBy(F.trim(F.col(key).cast("string")).alias(key)).agg(F.max_by(F.trim(F.col(value).cast("string")), sequence).alias(value))


MANIFEST = "family string, adapter string, source_url string, source_tier int, parser string, cadence_cron string, entity_hints map<string,string>"


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Source manifests as JSON records -> (valid, rejected)."""
    df = spark.read.schema(MANIFEST).json(path)
    ok = F.coalesce((F.trim("family") != "") & (F.trim("adapter") != "") & F.col("source_url").rlike("^https?://") & F.col("source_tier").isin(1, 2, 3) & (F.trim("parser") != ""), F.lit(False))
    return df.where(ok), df.where(~ok)


STATEMENT = "source_url string, source_family string, language string, speaker_hint string, excerpt_selector string, notes string"


def read_statement_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``#`` comments; url, family and language are required."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    rows = lines.select(F.from_json("value", STATEMENT).alias("r")).select("r.*")
    return rows.where(F.col("source_url").isNotNull() & F.col("source_family").isNotNull() & F.col("language").isNotNull())


def select_excerpt(text: Column, anchor: Column) -> Column:
    """The first line that holds the anchor, trimmed; without an anchor or a hit the whole text, trimmed."""
    hit = F.try_element_at(F.filter(F.split(text, "\n"), lambda line: line.contains(anchor)), F.lit(1))
    return F.trim(F.coalesce(F.when(F.length(anchor) > 0, hit), text))


def truncate_payload(payload: Column, max_lines: int | None = None, max_bytes: int | None = None) -> Column:
    """Binary payload cut to lines first, then to bytes."""
    out = payload
    if max_lines is not None:
        out = F.encode(F.array_join(F.slice(F.split(F.decode(out, "ISO-8859-1"), "\n"), 1, max_lines), "\n"), "ISO-8859-1")
    return F.substring(out, 1, max_bytes) if max_bytes is not None else out


def page_links(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """List links of raw pages: one row per ``<li><a href>``, in order."""
    items = F.regexp_extract_all(html, F.lit(r'(?s)<li><a href="([^"]*)">[^<]*</a></li>'), F.lit(0))
    rows = pages.select(*keys, F.posexplode(items).alias("at", "_i"))
    return rows.select(*keys, "at", F.regexp_extract("_i", 'href="([^"]*)"', 1).alias("href"), strip_tags(F.col("_i")).alias("label"))


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
