"""Points in intervals without comparing all of them: intervals are cut into nested buckets, points are in their ancestors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import free_name, named, stored

#: Each bucket holds 2^BITS of the next finer kind, so an interval has fewer than twice as many at each level.
BITS = 3
#: The coarsest level, of buckets of 2^57 numbers; keys are cut off at 2^62 in either direction.
TOP = 19


def _bucket(c: Column, level: Column | int) -> Column:
    """floor(c / 2^(BITS level)), of either sign."""
    return F.call_function("shiftright", c, (level if isinstance(level, Column) else F.lit(level)) * BITS)


def cover(lower: Column, upper: Column) -> Column:
    """Array of (level, bucket): disjoint buckets that together hold exactly the whole numbers of the closed interval.

    At each level these are the whole buckets inside the interval that lie in no whole bucket of the next level. Empty
    where a bound is null or the interval is.
    """
    low, high = (F.greatest(F.least(c.cast("long"), F.lit(1 << 62)), F.lit(-(1 << 62))) for c in (lower, upper))
    first = lambda k: _bucket(low + F.call_function("shiftleft", F.lit(1).cast("long"), k * BITS) - 1, k)
    end = lambda k: _bucket(high + 1, k)
    run = lambda a, b, k: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(k.alias("level"), x.alias("bucket"))))

    def level(k: Column) -> Column:
        up, down = first(k + 1) * (1 << BITS), end(k + 1) * (1 << BITS)
        alone = (k == TOP) | (up >= down)  # no whole bucket above
        left, right = run(first(k), F.when(alone, end(k)).otherwise(up), k), run(F.when(alone, end(k)).otherwise(down), end(k), k)
        return F.concat(F.coalesce(left, none), F.coalesce(right, none))

    none = F.array().cast("array<struct<level:int,bucket:bigint>>")
    levels = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TOP)), level))
    return F.when(F.coalesce(lower <= upper, F.lit(False)), levels).otherwise(none)


def points_in(points: DataFrame, point: str, intervals: DataFrame, lower: str, upper: str, keys: Sequence[str] = ()) -> DataFrame:
    """All pairs of a point and an interval (closed) that are equal on keys, with the columns of both; keys once.

    Intervals become a few buckets each, points one row for each level that some interval uses, and the two meet on
    equal keys, level and bucket: every pair once, none that must be dropped again. Null points, bounds and keys meet
    nothing; intervals that repeat meet each. Other columns of the same name on both sides are an error, as in any join.
    """
    level, bucket = (free_name(c, points, intervals) for c in ("level", "bucket"))
    placed, cut = _meeting(points, point, intervals, lower, upper, level, bucket)
    return placed.join(cut, [*keys, level, bucket]).drop(level, bucket)


def counts_in(points: DataFrame, point: str, intervals: DataFrame, ids: Sequence[str], lower: str, upper: str, by: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """(ids..., by..., points, first, last): how many points with each value of ``by`` an interval holds, its least and greatest.

    The summary of points_in's pairs without the pairs: points are summed up by bucket first, so an interval meets a few
    sums for each value of ``by``, however many points it holds. ``ids`` tell the intervals apart (those alike in them
    are summed together) and must not be among ``by``. Intervals without points have no row; null points, bounds and keys
    meet nothing, null ids and values of ``by`` stay.
    """
    level, bucket, n, first, last = (free_name(c, points, intervals) for c in ("level", "bucket", "points", "first", "last"))
    own = list(dict.fromkeys([*keys, *by]))
    same = points.groupBy(*[named(c) for c in dict.fromkeys([*own, point])]).agg(F.count("*").alias(n))
    held = intervals.select(*[named(c) for c in dict.fromkeys([*ids, *keys, lower, upper])])
    placed, cut = _meeting(same, point, held, lower, upper, level, bucket)
    sums = placed.groupBy(*[named(c) for c in own], named(level), named(bucket)).agg(F.sum(named(n)).alias(n), F.min(named(point)).alias(first), F.max(named(point)).alias(last))
    met = sums.join(cut.select(*[named(c) for c in dict.fromkeys([*ids, *keys])], named(level), named(bucket)), [*keys, level, bucket])
    return met.groupBy(*[named(c) for c in [*ids, *by]]).agg(F.sum(named(n)).alias("points"), F.min(named(first)).alias("first"), F.max(named(last)).alias("last"))


def _meeting(points: DataFrame, point: str, intervals: DataFrame, lower: str, upper: str, level: str, bucket: str) -> tuple[DataFrame, DataFrame]:
    """Points and intervals by level and bucket: points in those of all levels that some interval uses."""
    cut = intervals.withColumn(bucket, F.explode(cover(named(lower), named(upper))))
    cut = stored(cut.select(*[named(c) for c in intervals.columns], F.col(f"`{bucket}`.level").alias(level), F.col(f"`{bucket}`.bucket").alias(f"{bucket}")), "interval-buckets")
    used = sorted(r[0] for r in cut.select(level).distinct().collect())  # at most TOP + 1
    at = F.array(*[F.struct(F.lit(k).alias("level"), _bucket(named(point).cast("long"), k).alias("bucket")) for k in used]) if used else F.array().cast("array<struct<level:int,bucket:bigint>>")
    placed = points.where(named(point).isNotNull()).withColumn(bucket, F.explode(at))
    placed = placed.select(*[named(c) for c in points.columns], F.col(f"`{bucket}`.level").alias(level), F.col(f"`{bucket}`.bucket").alias(f"{bucket}"))
    return placed, cut


def documents_of(documents: DataFrame, requests: DataFrame, keys: Sequence[str], key: str, lower: str = "lower", upper: str = "upper", month: str | None = None, fine: str | None = None) -> DataFrame:
    """(request, document) rows by scope keys and period; documents without a month never match a quarter or half (``fine``)."""
    met = points_in(documents, key, requests, lower, upper, keys)
    return met if month is None or fine is None else met.where(~named(fine) | named(month).isNotNull())
