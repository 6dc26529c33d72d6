"""Time phrases -> intervals, as one expression over a phrase column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.schemas import TERM_CALENDAR

#: Month names in order. Fixed values.
MONTHS = ["ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט", "ספטמבר", "אוקטובר", "נובמבר", "דצמבר"]
#: Phrase patterns. Fixed values.
ISO_DAY = r"^(\d{4})-(\d{2})-(\d{2})$"
MONTH_YEAR = f"({'|'.join(MONTHS)})\\s+((?:19|20)\\d{{2}})"
TERM_HE = r"כנסת(?:\s+ה[-]?)?\s*(\d{1,2})"
TERM_EN = r"(\d{1,2})(?:st|nd|rd|th)?\s+[Kk]nesset"
LAST_YEAR = r"(?i)בשנה\s+שעברה|\blast\s+year\b"
LAST_TERM = r"(?i)(?:ה)?קדנציה\s+הקודמת|\blast\s+term\b"
YEAR = r"(?:^|[^\d])((?:19|20)\d{2})(?:[^\d]|$)"

SCOPE = "struct<start:timestamp,end:timestamp,granularity:string>"


def scope(start: Column, end: Column, granularity: str) -> Column:
    return F.struct(start.cast("timestamp").alias("start"), end.cast("timestamp").alias("end"), F.lit(granularity).alias("granularity"))


def last_second(day: Column) -> Column:
    """23:59:59 of a day."""
    return day.cast("timestamp") + F.expr("INTERVAL '0 23:59:59' DAY TO SECOND")


def unknown() -> Column:
    return scope(F.lit(None), F.lit(None), "unknown")


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def year_scope(year: Column) -> Column:
    return scope(F.make_date(year, F.lit(1), F.lit(1)), last_second(F.make_date(year, F.lit(12), F.lit(31))), "year")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` over a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def term_scope(number: Column) -> Column:
    """Bounds of a term; the current one is open; a number without a term gives null."""
    calendar = F.array(*[F.struct(F.lit(s).cast("date").alias("s"), F.lit(e).cast("date").alias("e")) for _, s, e in TERM_CALENDAR])
    return bind(F.get(calendar, number - 1), lambda row: F.when(row.isNotNull(), scope(row.s, last_second(row.e), "term")))


def term_at(ref: Column) -> Column:
    """Number of the first term that holds a date."""
    calendar = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).cast("date").alias("s"), F.lit(e).cast("date").alias("e")) for n, s, e in TERM_CALENDAR])
    inside = F.filter(calendar, lambda t: (ref >= t.s) & (t.e.isNull() | (ref <= t.e)))
    return F.get(inside, F.lit(0)).n


def normalize_time_scope(phrase: Column, reference: Column) -> Column:
    """First rule that applies: ISO day, month and year, term number, last year, last term, year; else unknown.

    The parts of the phrase are found first, each by one search; the rules read them.
    """

    def parts(x: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), first_group(x.t, MONTH_YEAR)).cast("int")
        return F.struct(
            x.t.alias("t"), x.ref.alias("ref"), F.when(x.t.rlike(ISO_DAY), F.try_to_date(x.t, "yyyy-MM-dd")).alias("day"), F.make_date(first_group(x.t, MONTH_YEAR, 2).cast("int"), month, F.lit(1)).alias("first"),
            first_group(x.t, TERM_HE).cast("int").alias("he"), first_group(x.t, TERM_EN).cast("int").alias("en"), first_group(x.t, YEAR).cast("int").alias("year"),
        )

    def rules(p: Column) -> Column:
        number = F.when(p.he.between(1, len(TERM_CALENDAR)), p.he).when(p.en.between(1, len(TERM_CALENDAR)), p.en).when(p.t.rlike(LAST_TERM) & ~p.t.rlike(LAST_YEAR), term_at(p.ref) - 1)
        year = F.when(p.t.rlike(LAST_YEAR), F.year(p.ref) - 1)
        return F.when(p.day.isNotNull(), scope(p.day, last_second(p.day), "day")).when(p["first"].isNotNull(), scope(p["first"], last_second(F.last_day(p["first"])), "month")).otherwise(
            bind(F.struct(term_scope(number).alias("term"), year.alias("last"), p.year.alias("year")), lambda q: F.coalesce(q.term, year_scope_or_null(F.coalesce(q.last, q.year)), unknown()))
        )

    t = F.struct(F.trim(F.coalesce(phrase, F.lit(""))).alias("t"), reference.cast("date").alias("ref"))
    return bind(bind(t, parts), rules)


def year_scope_or_null(year: Column) -> Column:
    return F.when(year.isNotNull(), year_scope(year))


def utterance_time(text: Column) -> Column:
    """The first ISO date of a text if it is one, else 1 January of its first year, else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    day = F.try_to_date(first_group(t, r"(\d{4}-\d{2}-\d{2})"), "yyyy-MM-dd")
    return F.coalesce(day.cast("timestamp"), F.make_date(first_group(t, YEAR).cast("int"), F.lit(1), F.lit(1)).cast("timestamp"))
