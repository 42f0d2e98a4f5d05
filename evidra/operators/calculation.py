"""Calculation plans over whole tables: which plans are sound, and what the sound ones come to.

A plan names an operation and the sources it rests on; its facts are rows (plan, position, value). All plans are worked
out in one grouping of the facts, whatever their operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from .calc import AGGREGATE, SCALAR

#: Operations on numbers by position; two unless stated.
ARGUMENTS = {name: 2 for name in SCALAR if name not in ("convert_krw_unit", "normalize_percent")} | {"cagr": 3, "safe_round": 1}
#: Aggregates of one value.
OVER_ALL = [name for name in AGGREGATE if name != "weighted_average"]


def checked_plans(plans: DataFrame, sources: DataFrame, chunks: DataFrame, plan: str = "plan_id", source: str = "source_id") -> DataFrame:
    """(plan, answerable, operation, fault): plans (plan, answerable, operation) against the chunks (plan, source) they were given.

    A source that is not among the plan's chunks is a fault (the unknown ones are listed in order), else an operation
    that is not supported; a plan that is not answerable has no operation and needs none. Null answerable counts as
    false. Plans without sources are sound; a null source is no source.
    """
    known = chunks.select(plan, source).distinct()
    unknown = sources.where(F.col(source).isNotNull()).join(known, [plan, source], "left_anti")
    listed = unknown.groupBy(plan).agg(F.array_join(F.array_sort(F.collect_set(F.col(source).cast("string"))), ", ").alias("_unknown"))
    can, name = F.coalesce(F.col("answerable"), F.lit(False)), F.col("operation")
    supported = F.coalesce(name.isin([*ARGUMENTS, *OVER_ALL]), F.lit(False))
    fault = F.when(F.col("_unknown").isNotNull(), F.concat(F.lit("unknown sources: "), "_unknown")).when(can & ~supported, F.concat(F.lit("unsupported operation: "), F.coalesce(name, F.lit("none"))))
    return plans.join(listed, plan, "left").select(plan, can.alias("answerable"), F.when(can, name).alias("operation"), fault.alias("fault"))


def _value(name: Column, arguments: list[Column], totals: dict[str, Column]) -> Column:
    found = [F.when(name == op, SCALAR[op](*arguments[:n])) for op, n in ARGUMENTS.items()]
    return N.finite(F.coalesce(*found, *[F.when(name == op, total) for op, total in totals.items()]))


def run_plans(checked: DataFrame, facts: DataFrame, plan: str = "plan_id", position: str = "position", value: str = "value") -> DataFrame:
    """Adds result and status to checked plans: fault, insufficient (not answerable), undefined (no value), or ok.

    Values that are null or not finite are left out; of rows that repeat a position the largest value counts for
    operations by position, every row for aggregates.
    """
    v = N.finite(F.col(value))
    by_position = [F.max(F.when(F.col(position) == k, v)).alias(f"_a{k}") for k in range(1, 1 + max(ARGUMENTS.values()))]
    totals = [AGGREGATE[op](v).alias(f"_t_{op}") for op in OVER_ALL]
    joined = checked.join(facts.groupBy(plan).agg(*by_position, *totals), plan, "left")
    got = _value(F.col("operation"), [F.col(f"_a{k}") for k in range(1, 1 + len(by_position))], {op: F.col(f"_t_{op}") for op in OVER_ALL})
    result = F.when(F.col("fault").isNull() & F.col("answerable"), got)
    status = F.when(F.col("fault").isNotNull(), "fault").when(~F.col("answerable"), "insufficient").when(result.isNull(), "undefined").otherwise("ok")
    return joined.select(*[F.col(f"`{c}`") for c in checked.columns], result.alias("result"), status.alias("status"))


def selected_sources(checked: DataFrame, sources: DataFrame, chunks: DataFrame, plan: str = "plan_id", source: str = "source_id") -> DataFrame:
    """The chunks that sound plans name, once each."""
    sound = checked.where(F.col("fault").isNull()).select(plan)
    return chunks.join(sources.select(plan, source).distinct(), [plan, source], "left_semi").join(sound, plan, "left_semi")


def fallback_notices(fallbacks: DataFrame, used: DataFrame, keys: list[str], requested: str, period: str, chunk: str = "chunk_id") -> DataFrame:
    """(keys..., requested, period): one row for each period that stood in for a requested one and whose chunk an answer used."""
    real = used.where(F.trim(F.coalesce(F.col(chunk), F.lit(""))) != "").select(F.trim(chunk).alias(chunk)).distinct()
    kept = fallbacks.withColumn(chunk, F.trim(chunk)).join(real, chunk, "left_semi")
    return kept.groupBy(*keys, period).agg(F.min(requested).alias(requested)).select(*keys, requested, period)


def answer_with_sources(answers: DataFrame, sources: DataFrame, key: str, answer: str, label: str, order: str) -> DataFrame:
    """(key, text): each answer with its distinct sources below it, by first place; blank labels are left out."""
    named = sources.where(F.trim(F.coalesce(F.col(label), F.lit(""))) != "").groupBy(key, F.trim(label).alias("_label")).agg(F.min(order).alias("_place"))
    lines = named.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_label"))), lambda x: F.concat(F.lit("- "), x["_label"])), "\n").alias("_lines"))
    text = F.rtrim(F.coalesce(F.col(answer), F.lit("")))
    return answers.join(lines, key, "left").select(key, F.when(F.col("_lines").isNull(), text).otherwise(F.concat(text, F.lit("\n\n"), "_lines")).alias("text"))
