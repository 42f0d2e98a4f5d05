"""The calculation library over long tables: sums, changes, growth, shares, ranks with all ties, windows, units.

Each operator takes and returns a DataFrame, or builds columns; a failing row (zero base, bad input) gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N

#: Binary and unary operations by name; every name takes columns and gives a column.
SCALAR: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": N.divide,
    "absolute_change": lambda new, old: new - old,
    "difference": lambda a, b: a - b,
    "percent_change": N.percent_change,
    "growth_rate": N.percent_change,
    "relative_difference": N.percent_change,
    "percentage_point_change": lambda new, old: new - old,
    "cagr": N.cagr,
    "ratio": N.divide,
    "share": lambda part, whole: N.divide(part, whole) * 100,
    "convert_krw_unit": N.convert_krw,
    "normalize_percent": N.normal_percent,
    "safe_round": N.half_even,
}
#: Aggregates by name over a value (and a weight).
AGGREGATE: dict[str, Callable[..., Column]] = {
    "sum": lambda v: F.sum(v),
    "total": lambda v: F.sum(v),
    "average": lambda v: F.avg(v),
    "mean": lambda v: F.avg(v),
    "median": lambda v: F.median(v),
    "weighted_average": lambda v, w: F.try_divide(F.sum(v * w), F.sum(w)),
    "max": lambda v: F.max(v),
    "min": lambda v: F.min(v),
}


def evaluate(df: DataFrame, name: str, columns: Sequence[str], out: str = "result") -> DataFrame:
    """Adds (out, success, error): the operation's value, whether it has one, and why not."""
    if name not in SCALAR:
        return df.select("*", F.lit(None).cast("double").alias(out), F.lit(False).alias("success"), F.lit(f"unsupported operation {name}").alias("error"))
    inputs = [N.finite(F.col(c)) for c in columns]
    value = N.finite(SCALAR[name](*inputs))
    missing = F.lit(False)
    for c in inputs:
        missing = missing | c.isNull()
    return df.select("*", value.alias(out), value.isNotNull().alias("success"), F.when(missing, "missing or non-finite input").when(value.isNull(), "undefined for these inputs").alias("error"))


def aggregate(df: DataFrame, keys: Sequence[str], **named: tuple[str, ...]) -> DataFrame:
    """One row a group; named: result = (operation, value column, weight column?)."""
    return df.groupBy(*keys).agg(*[AGGREGATE[op](*[F.col(c) for c in cols]).alias(out) for out, (op, *cols) in named.items()])


def period_changes(df: DataFrame, series: Sequence[str], period: str, value: str) -> DataFrame:
    """Adds previous, change and change_pct against the period before in the series."""
    w = Window.partitionBy(*series).orderBy(period)
    previous = F.lag(value).over(w)
    return df.select("*", previous.alias("previous"), (F.col(value) - previous).alias("change"), N.percent_change(F.col(value), previous).alias("change_pct"))


def composition_shares(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*groups))
    return df.select("*", (F.try_divide(F.col(value), total) * 100).alias("share_pct"))


def compare_two(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds difference, absolute_difference, and larger and smaller (null on a tie)."""
    x, y = F.col(a), F.col(b)
    return df.select("*", (x - y).alias("difference"), F.abs(x - y).alias("absolute_difference"), F.when(x > y, a).when(y > x, b).alias("larger"), F.when(x < y, a).when(y < x, b).alias("smaller"))


def extremes(df: DataFrame, groups: Sequence[str], key: str, value: str, largest: bool = True) -> DataFrame:
    """(groups..., value, keys, is_tie): every key that reaches the extreme, in key order."""
    best = df.groupBy(*groups).agg((F.max if largest else F.min)(value).alias("_best"))
    same = df.join(best, list(groups)) if groups else df.crossJoin(F.broadcast(best))
    held = same.where(F.col(value) == F.col("_best")).groupBy(*groups, F.col("_best").alias(value)).agg(F.array_sort(F.collect_set(key)).alias("keys"))
    return held.withColumn("is_tie", F.size("keys") > 1)


def competition_rank(df: DataFrame, groups: Sequence[str], value: str, largest_first: bool = True) -> DataFrame:
    """Adds rank (1, 1, 3 for ties)."""
    order = F.col(value).desc() if largest_first else F.col(value).asc()
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*groups).orderBy(order)))


def cumulative_sum(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(value).over(w))


def same_unit(df: DataFrame, groups: Sequence[str], unit: str) -> DataFrame:
    """(groups..., units, same_unit)."""
    return df.groupBy(*groups).agg(F.count_distinct(unit).alias("units")).withColumn("same_unit", F.col("units") <= 1)


def part_sequences(df: DataFrame, key: str, part: str) -> DataFrame:
    """(key, parts, complete): whether the distinct parts are 1 to the largest; sums and counts only, no lists."""
    distinct = df.select(key, part).distinct()
    got = distinct.groupBy(key).agg(F.count(part).alias("parts"), F.min(part).alias("low"), F.max(part).alias("high"))
    return got.select(key, "parts", ((F.col("low") == 1) & (F.col("high") == F.col("parts"))).alias("complete"))


def sliding_groups(df: DataFrame, groups: Sequence[str], order: Sequence[str], item: str, n: int) -> DataFrame:
    """Every run of n consecutive items of a group, as (groups..., items)."""
    w = Window.partitionBy(*groups).orderBy(*order)
    items = F.collect_list(item).over(w.rowsBetween(0, n - 1))
    return df.select(*groups, items.alias("items")).where(F.size("items") == n)


def sample_rows(df: DataFrame, id_column: str, n: int, seed: str) -> DataFrame:
    """n rows by a hash of id and seed: the same rows wherever they are stored."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_column).cast("string")), 256), id_column).limit(n)


def assert_count(df: DataFrame, expected: int) -> DataFrame:
    """df, if it has that many rows; raises otherwise."""
    found = df.count()
    if found != expected:
        raise ValueError(f"expected {expected} rows, found {found}")
    return df
