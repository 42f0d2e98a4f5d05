"""Period keys (yyyymmdd as integers), period literals, intents and date bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a year, optionally with a quarter, a half or a month and day.
PERIOD = r"^(\d{4})(?:-(?:(\d{2})-(\d{2})|Q([1-4])|H([12])))?$"
#: The periodic reports, and the month each kind of period ends in.
PERIODIC = ("annual_report", "semiannual_report", "quarterly_report")


def date_key(c: Column) -> Column:
    """The key of an eight-digit date among other signs; null if it is no valid date."""
    digits = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\D", "")
    day = F.try_to_date(F.when(F.length(digits) == 8, digits), "yyyyMMdd")
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def key_of(day: Column) -> Column:
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def _part(c: Column, k: int) -> Column:
    return F.nullif(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), PERIOD, k), F.lit("")).try_cast("int")


def period_bounds(c: Column) -> tuple[Column, Column]:
    """First and last key of a period literal; null for others and for days that do not exist."""
    year, month, day, quarter, half = (_part(c, k) for k in range(1, 6))
    first = F.coalesce(month, quarter * 3 - 2, half * 6 - 5, F.lit(1))
    last = F.coalesce(month, quarter * 3, half * 6, F.lit(12))
    exact = date_key(F.when(day.isNotNull(), c))
    end = F.dayofmonth(F.last_day(F.make_date(year, last, F.lit(1))))
    lower = F.when(day.isNotNull(), exact).otherwise(year * 10000 + first * 100 + 1)
    upper = F.when(day.isNotNull(), exact).otherwise(year * 10000 + last * 100 + end)
    return lower, upper


def half_month(c: Column) -> Column:
    """H1 is June, H2 December; other texts null."""
    return F.when(F.upper(c).isin("H1", "1"), 6).when(F.upper(c).isin("H2", "2"), 12)


def effective_basis(event: Column, received: Column, asked: Column, fallback: bool = True) -> Column:
    """The date basis a document is held to: an invalid event date falls back to the receipt date."""
    usable = F.when(event.isNotNull(), F.lit("event_date"))
    if fallback:
        usable = usable.when(received.isNotNull(), F.lit("rcept_dt"))
    return F.when(asked == "event_date", usable).otherwise(asked)


def period_intent(c: Column) -> Column:
    """(kind, report, month) of a question's wording, by the first rule that fits; null if none does."""
    text = F.coalesce(c, F.lit(""))
    quarter = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"제?\s*([1-4])\s*분기", r"(?i)Q([1-4])", r"(?i)([1-4])Q")])
    months = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(1[0-2]|0?[1-9])\s*월"), F.lit(1)), lambda m: m.cast("int")))
    single = F.when(F.size(months) == 1, F.element_at(months, 1))
    row = lambda kind, report, month: F.struct(F.lit(kind).alias("kind"), (F.lit(report) if isinstance(report, str) else report).alias("report"), (F.lit(month) if isinstance(month, int) else month).cast("int").alias("month"))
    by_month = F.when(single == 12, F.lit("annual_report")).when(single == 6, F.lit("semiannual_report")).otherwise(F.lit("quarterly_report"))
    by_quarter = F.when(quarter == "4", F.lit("annual_report")).when(quarter == "2", F.lit("semiannual_report")).otherwise(F.lit("quarterly_report"))
    return (
        F.when(quarter.isNotNull(), row("quarter", by_quarter, quarter.cast("int") * 3))
        .when(text.rlike("(?i)상반기|(?<!하)반기|H1|1H"), row("half", "semiannual_report", 6))
        .when(text.rlike("(?i)연간|연도별|연말|온기|사업연도|FY|사업보고서"), row("annual", "annual_report", 12))
        .when(single.isin(3, 6, 9, 12), row("month", by_month, single))
        .when(single.isNotNull(), F.lit(None))
        .when(text.rlike("분기"), row("any_quarter", "quarterly_report", F.lit(None)))
        .when(text.rlike(r"(?<!\d)(19|20)\d\d(?!\d)") & (F.size(months) == 0), row("annual", "annual_report", 12))
    )
