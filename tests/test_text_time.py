import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from verisift.functions import keys, text, timescope

HE = "הַכְּנֶסֶת  שלום"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("kind,ext", [("knesset_person", "7"), ("party", "שלום"), ("x", "")])
def test_uuid5(spark, kind, ext):
    assert one(spark, keys.entity_key(kind, F.col("e")), e=ext) == str(uuid.uuid5(uuid.UUID(keys.NAMESPACE), f"{kind}:{ext}"))


def test_hebrew(spark):
    assert one(spark, text.normalize_hebrew(F.col("t"), compose=True), t=HE) == "הכנסת שלום"
    assert one(spark, text.normalize_hebrew(F.col("t")), t=None) == ""
    assert one(spark, text.normalize_hebrew(F.col("t"), compose=True), t="é  x\n") == "é x"
    assert one(spark, text.transliterate_hebrew(F.col("t")), t="צחי כהן שרץ Ab") == "tzchy khn shrtz ab"


def test_casts(spark):
    assert one(spark, text.vote_share(F.col("t")), t="23.41%") == 0.2341 and one(spark, text.vote_share(F.col("t")), t="n/a") == 0.0
    assert one(spark, text.parse_int(F.col("t")), t=" 12 ") == 12 and one(spark, text.parse_int(F.col("t")), t="x") is None
    assert one(spark, text.parse_bool(F.col("t")), t="Yes") is True and one(spark, text.parse_bool(F.col("t")), t="maybe") is None
    assert one(spark, text.strip_tags(F.col("t")), t=" <b>x</b> ") == "x"
    assert one(spark, text.vote_value(F.col("t")), t="נמנעה") == "abstain"
    for raw, want in (("2020-01-02", dt.datetime(2020, 1, 2)), ("2020-01-02 03:04:05", dt.datetime(2020, 1, 2, 3, 4, 5)), ("2020-01-02T03:04:05", dt.datetime(2020, 1, 2, 3, 4, 5)), ("bad", None), (None, None)):
        assert one(spark, text.safe_timestamp(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    "cron,seconds", [("*/5 * * * *", 300), ("*/0 * * * *", 60), ("*/x * * * *", None), ("7 * * * *", 3600), ("7 3 * * *", 86400), ("7 3 1 * *", 86400), ("7 3", None), (None, None), ("", None)]
)
def test_cadence(spark, cron, seconds):
    assert one(spark, text.cadence_seconds(F.col("t")), t=cron) == seconds


@pytest.mark.parametrize(
    "phrase,start,end,granularity",
    [
        ("2024-02-03", "2024-02-03", "2024-02-03", "day"), ("2024-13-45", "2024-01-01", "2024-12-31", "year"), ("בפברואר 2024", "2024-02-01", "2024-02-29", "month"), ("כנסת ה-24", "2020-12-22", "2022-11-15", "term"), ("the 25th Knesset", "2022-11-15", None, "term"),
        ("כנסת 99", None, None, "unknown"), ("last year", "2022-01-01", "2022-12-31", "year"), ("בשנה שעברה", "2022-01-01", "2022-12-31", "year"), ("last term", "2020-12-22", "2022-11-15", "term"), ("הקדנציה הקודמת", "2020-12-22", "2022-11-15", "term"),
        ("in 1999", "1999-01-01", "1999-12-31", "year"), ("number 119990", None, None, "unknown"), ("", None, None, "unknown"), (None, None, None, "unknown"),
    ],
)
def test_time_scope(spark, phrase, start, end, granularity):
    got = one(spark, timescope.normalize_time_scope(F.col("t"), F.to_date(F.lit("2023-06-01"))), t=phrase)
    day = lambda x: None if x is None else str(x.date())
    assert (day(got.start), day(got.end), got.granularity) == (start, end, granularity)
    assert got.end is None or (got.end.hour, got.end.minute, got.end.second) == (23, 59, 59)


def test_utterance_time(spark):
    for raw, want in (("on 2020-05-06 he", dt.datetime(2020, 5, 6)), ("on 2020-99-06", dt.datetime(2020, 1, 1)), ("year 1999.", dt.datetime(1999, 1, 1)), ("12345", None), (None, None)):
        assert one(spark, timescope.utterance_time(F.col("t")), t=raw) == want
