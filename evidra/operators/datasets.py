"""Training-set builders: splits, comparison groups, bundles, record fields and group names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def hash_share(id_column: Column, seed: str) -> Column:
    """A number from 0 to 1: the first 12 hex digits of the SHA-256 of seed and id."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed), id_column.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("double") / F.lit(float(2**48 - 1))


def hash_split(id_column: Column, seed: str, train: float = 0.8, validation: float = 0.1) -> Column:
    u = hash_share(id_column, seed)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def time_split(year: Column, train_end: int, validation: Sequence[int], test_start: int) -> Column:
    return F.when(year <= train_end, "train").when(year.isin(*validation), "validation").when(year >= test_start, "test").otherwise("unused")


def group_name(kind: Column, ids: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", kind, F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")).cast("binary")), 1, 12)


def comparison_groups(records: DataFrame, keys: Sequence[str], order: Sequence[str], id_column: str, n: int, kind: str) -> DataFrame:
    """(keys..., ids, kind, group_id): runs of n consecutive records of equal keys, each set of ids once."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = records.select(*keys, F.collect_list(id_column).over(w.rowsBetween(0, n - 1)).alias("ids"))
    sets = runs.where((F.size("ids") == n) & (F.size(F.array_distinct("ids")) == n)).withColumn("ids", F.array_sort("ids"))
    return sets.dropDuplicates(["ids"]).withColumn("kind", F.lit(kind)).withColumn("group_id", group_name(F.lit(kind), F.col("ids")))


def bundles(records: DataFrame, keys: Sequence[str], order: Sequence[str], id_column: str, text: str, n: int, most_chars: int) -> DataFrame:
    """(keys..., bundle, ids, context): every n records of a key in order, texts joined and cut to the budget."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = records.withColumn("_place", place).withColumn("bundle", F.floor(F.col("_place") / n))
    held = F.array_sort(F.collect_list(F.struct("_place", F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("text"))))
    got = rows.groupBy(*keys, "bundle").agg(held.alias("_held"))
    return got.select(*keys, "bundle", F.transform("_held", lambda x: x["id"]).alias("ids"), F.substring(F.array_join(F.transform("_held", lambda x: x["text"]), "\n\n"), 1, most_chars).alias("context"))


def numeric_labels(fields: Column) -> Column:
    """Names of a map whose value has a digit, in order."""
    return F.array_sort(F.map_keys(F.map_filter(fields, lambda k, v: v.rlike(r"\d"))))


def changed_fields(records: DataFrame, keys: Sequence[str], order: Sequence[str], fields: str) -> DataFrame:
    """Adds changed: names whose value differs from the record before of the same keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(fields).over(w)
    return records.withColumn("_before", before).withColumn("changed", F.array_sort(F.map_keys(F.map_filter(F.col(fields), lambda k, v: F.col("_before").isNotNull() & ~v.eqNullSafe(F.try_element_at(F.col("_before"), k)))))).drop("_before")


def dense_ids(rows: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Adds whole numbers from 0 in that order; see :func:`numbering.numbered`."""
    return numbered(rows, order, name, 0)


def training_text(question: Column, context: Column, with_context: bool = True) -> Column:
    return F.concat(context, F.lit("\n\n"), question) if with_context else question


def template_questions(fields: Column, templates: dict[str, str]) -> Column:
    """(question, answer) for each field that a template asks about."""
    asked = [F.when(F.try_element_at(fields, F.lit(name)).isNotNull(), F.struct(F.lit(q).alias("question"), F.try_element_at(fields, F.lit(name)).alias("answer"))) for name, q in templates.items()]
    return F.array_compact(F.array(*asked))
