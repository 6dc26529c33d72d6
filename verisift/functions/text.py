"""Text columns: normal forms, transliteration, tolerant casts. All Column expressions but NFC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, for patterns. Fixed value.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normalize_hebrew(c: Column, compose: bool = False) -> Column:
    """Points and accents dropped, white space squeezed; null becomes ''.

    compose=True also applies NFC, which leaves the JVM; only rows that hold combining marks are sent there.
    """
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\u0591-\\u05C7]", "")
    if compose:
        plain = F.when(plain.rlike(r"\p{M}|[\x{1100}-\x{11FF}\x{FB1D}-\x{FB4F}]"), nfc(plain)).otherwise(plain)
    return squeeze(plain)


#: Letters with one Latin letter each, and those with two. Fixed values.
SINGLE = ("אבגדהוזטיכךלמםנןסעפףקרת", "abgdhvztykklmmnnsapfkrt")
DOUBLE = {"ח": "ch", "צ": "tz", "ץ": "tz", "ש": "sh"}


def transliterate_hebrew(c: Column, compose: bool = False) -> Column:
    out = F.translate(normalize_hebrew(c, compose), *SINGLE)
    for letter, latin in DOUBLE.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return F.lower(F.trim(out))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def has_hebrew(c: Column) -> Column:
    return c.rlike(r"[\x{0590}-\x{05FF}]")


#: Vote words. Fixed values.
VOTE_WORDS = {"for": ["בעד", "for", "in favor of", "in favour of"], "against": ["נגד", "against", "opposed"], "abstain": ["נמנע", "נמנעה", "abstained", "to abstain"]}


def vote_value(c: Column) -> Column:
    word = F.lower(F.trim(c))
    out = F.lit(None).cast("string")
    for value, words in VOTE_WORDS.items():
        out = F.when(word.isin(words), F.lit(value)).otherwise(out)
    return out


def parse_int(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("int")


def parse_bool(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)


def vote_share(c: Column) -> Column:
    """'23.41%' -> 0.2341, six digits; unreadable -> 0.0."""
    return F.coalesce(F.round(F.regexp_replace(c, "%+$", "").try_cast("double") / 100.0, 6), F.lit(0.0))


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]+>", ""))


def safe_timestamp(c: Column) -> Column:
    """ISO date or date-time with 'T' or one space; a date alone is its midnight; unreadable -> null."""
    t = F.trim(c.cast("string"))
    t = F.when(t.contains("T"), t).when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00"))).otherwise(F.regexp_replace(t, "^([^ ]*) ", "$1T"))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd'T'HH:mm[XXX]")])


def cadence_seconds(cron: Column) -> Column:
    """Seconds between runs of a five-field cadence, at least: */N minutes (60 s or more), hourly, else daily; bad -> null."""
    p = F.split(squeeze(cron), " ")
    minute, hour = p[0], p[1]
    every = F.substring(minute, 3, 9)
    daily = (p[2] == "*") & (p[3] == "*") & (p[4] == "*")
    return (
        F.when(F.coalesce(F.size(p), F.lit(0)) != 5, None)
        .when(minute.startswith("*/"), F.when(every.try_cast("int").isNotNull(), F.greatest(F.lit(60), every.try_cast("int") * 60)))
        .when(daily & (hour == "*") & minute.rlike("^[0-9]+$"), 3600)
        .otherwise(86400)
        .cast("int")
    )
