"""Numbers in texts and calculations: units, percents, tokens, rounding. Zero denominators give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Won of each unit.
KRW_UNITS = {"원": 1.0, "천원": 1e3, "만원": 1e4, "백만원": 1e6, "억원": 1e8, "조원": 1e12}
#: Units that a number may carry.
NUMERIC_UNITS = ("억원", "만원", "천원", "원", "달러", "USD", "%", "대", "주", "개", "배", "명", "건")


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def percent_change(new: Column, old: Column) -> Column:
    """Against the signed base; null for a base of zero."""
    return F.try_divide(new - old, old) * 100


def cagr(start: Column, end: Column, periods: Column) -> Column:
    ok = (start > 0) & (end >= 0) & (periods > 0)
    return F.when(ok, (F.pow(F.try_divide(end, start), F.try_divide(F.lit(1.0), periods)) - 1) * 100)


def finite(c: Column) -> Column:
    """The value as a double if it is one and finite, else null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def convert_krw(value: Column, source: Column, target: Column) -> Column:
    """Between the won units; null for an unknown unit."""
    unit = F.create_map(*[F.lit(x) for kv in KRW_UNITS.items() for x in kv])
    return F.try_divide(value * F.try_element_at(unit, source), F.try_element_at(unit, target))


def normal_percent(value: Column, is_ratio: Column) -> Column:
    return F.when(is_ratio, value * 100).otherwise(value)


def half_even(c: Column, digits: int = 4) -> Column:
    return F.bround(c, digits)


def number_value(c: Column) -> Column:
    """Digits with separators as a double; null if the text is no number."""
    return F.regexp_replace(c, r"[,\s]", "").try_cast("double")


def normal_number(c: Column) -> Column:
    """Without separators and a trailing zero fraction: 97,000.00 is 97000; leading zeros stay."""
    bare = F.regexp_replace(c, r"[,\s]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def number_tokens(c: Column) -> Column:
    """Distinct numbers of a text; separators go, and a percent sign stays even after a blank."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d[\d,]*(?:\.\d+)?(?:\s*%)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[,\s]", "")))


def bare_numbers(c: Column) -> Column:
    """Distinct normal forms of the numbers that do not follow a letter or digit: of A4 and 97,000.00 only 97000."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![A-Za-z0-9])\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, normal_number), lambda x: x != ""))


def answer_numbers(c: Column) -> Column:
    """Numbers with a unit or percent; if there are none, bare ones other than years from 1900 to 2100 and single digits."""
    text = F.coalesce(c, F.lit(""))
    units = "|".join(["조원", "백만원", *NUMERIC_UNITS])
    marked = F.transform(F.regexp_extract_all(text, F.lit(rf"(\d[\d,]*(?:\.\d+)?)\s*(?:{units})"), F.lit(1)), lambda x: F.regexp_replace(x, ",", ""))
    year = lambda x: x.rlike("^(?:19\\d\\d|20\\d\\d|2100)$")
    bare = F.filter(F.transform(number_tokens(text), lambda x: F.regexp_replace(x, "%", "")), lambda x: ~year(x) & (F.length(x) > 1))
    return F.array_distinct(F.when(F.size(marked) > 0, marked).otherwise(bare))


def number_units(c: Column) -> Column:
    """Distinct 'number unit' pairs of a text, units behind the number in any case, USD also before it."""
    text = F.coalesce(c, F.lit(""))
    units = "|".join(sorted(NUMERIC_UNITS, key=len, reverse=True))
    behind, before = F.lit(rf"(?i)(\d[\d,]*(?:\.\d+)?)\s*({units})"), F.lit(r"(?i)\bUSD\s*(\d[\d,]*(?:\.\d+)?)")
    unit = lambda u: F.when(F.upper(u) == "USD", "USD").otherwise(u)
    pairs = F.zip_with(F.regexp_extract_all(text, behind, F.lit(1)), F.regexp_extract_all(text, behind, F.lit(2)), lambda n, u: F.concat_ws(" ", normal_number(n), unit(u)))
    dollars = F.transform(F.regexp_extract_all(text, before, F.lit(1)), lambda n: F.concat_ws(" ", normal_number(n), F.lit("USD")))
    return F.array_distinct(F.concat(pairs, dollars))
