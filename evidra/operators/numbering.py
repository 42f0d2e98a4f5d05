"""Whole numbers in a global order, found in every partition at once."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import free_name, stored


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """rows with whole numbers from ``start`` in that order; ties in any order, but each number once.

    Rows are dealt into ranges, sorted and counted on within each; one count a range comes to the driver, whose running
    sums are added. The sorted ranges are written first, so that a lost executor cannot number anew. An empty table stays
    empty; a column that has the name gives way.
    """
    kept = [c for c in rows.columns if c.lower() != name.lower()]
    at, offset = free_name("_at", rows), free_name("_offset", rows)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ranged = stored(ranged.select(*[F.col(f"`{c}`") for c in kept], at), "numbered")
    part = F.shiftright(at, 33).cast("int")
    counts = sorted(ranged.groupBy(part.alias("part")).count().collect())
    offsets = [(p, o) for (p, _), o in zip(counts, accumulate((n for _, n in counts), initial=start), strict=False)]
    sums = rows.sparkSession.createDataFrame(offsets, f"{offset}_of int, {offset} long")
    joined = ranged.join(F.broadcast(sums), part == F.col(f"{offset}_of"))
    return joined.select(*[F.col(f"`{c}`") for c in kept], (F.col(offset) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
