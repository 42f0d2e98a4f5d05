"""Mixing sources to target weights.

Token totals per source give each source a repetition rate; each document is emitted floor(rate) times,
plus one Bernoulli copy whose draw is seeded by a hash of its id and whose probability is the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import free_name, named
from .common import WORD, draw, stored

#: A source table of at most so many rows is broadcast; a larger one is joined by shuffle, its hot keys split by AQE.
BROADCAST_SOURCES = 50_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order (null last) take the weights in turn. Targets share ``share`` times all sizes by
    weight; a target stops at ``most`` times its source's size and the excess is shared again by weight among the
    rest, until none is above. Only one number a round comes to the driver.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last())
    ranked = spark.createDataFrame(
        ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])),
        T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("position", T.LongType())]),
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    sources = stored(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("ceiling")), "mix-sources")
    size, weight_sum = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * (size or 0)
    level = total / weight_sum if weight_sum else 0.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("ceiling")
        stopped, rest = sources.agg(F.sum(F.when(above, F.col("ceiling")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        following = (total - stopped) / rest if rest else level
        if following <= level:
            break
        level = following
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("ceiling")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix-1", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep`` with source, size, source_size, target and copies (how often the mix emits the document).

    ``docs`` has doc_id, text and source. Null texts have size 0; a source without words has target 0 and copies 0.
    Rows that repeat an id draw alike. Ties do not arise: every row is decided alone. An empty table gives an empty one.
    A column of ``keep`` that has the name of one of those gives way to it; other columns are not read.
    """
    own = [c for c in dict.fromkeys([*keep, "doc_id"]) if c not in ("source", "size", "source_size", "target", "copies")]
    sized = stored(docs.select(*[named(c) for c in own], "source", word_count().alias("size")), "mix-sizes")
    sources = source_targets(sized, weights, share, most)
    few = sources.count() <= BROADCAST_SOURCES
    of = free_name("mix_source", sized)
    side = sources.withColumnRenamed("source", of)
    joined = sized.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col(of))).drop(of)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.when(draw("doc_id", seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies)


def emit(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as :func:`mix` says, with all its columns, whatever their names.

    Rows are decided alone, so repeated rows and ids are each emitted as often as their own draw says (equal ids draw
    alike). Rows without words have size 0; a source without words emits none of its rows. An empty table gives an empty one.
    """
    sources = source_targets(stored(docs.select("source", word_count().alias("size")), "mix-sizes"), weights, share, most)
    few = sources.count() <= BROADCAST_SOURCES
    side = sources.select(F.col("source").alias("mix_source"), (F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("rate"))
    rows = docs.select("doc_id", "source", F.struct(*[named(c) for c in docs.columns]).alias("row"))
    joined = rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("mix_source")))
    copies = F.floor("rate") + F.when(draw("doc_id", seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    times = F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>"))
    return joined.select("row", F.explode(times)).select(*[named(c, "row").alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    out = mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS ceiling,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM totals),
ranked AS (
  SELECT *, row_number() OVER w AS k, sum(ceiling) OVER w AS c, sum(weight) OVER w AS u,
         sum(weight) OVER () AS all_weight, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM placed WINDOW w AS (ORDER BY ceiling / weight, source ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT (total - (c - ceiling)) / (all_weight - (u - weight)) AS level, ceiling / weight AS stop, k FROM ranked),
chosen AS (SELECT level FROM levels WHERE level <= stop ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(weight * level, ceiling) AS target FROM placed, chosen),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT d.doc_id, d.size, r.source_size, r.target,
       ((floor(rate) + CASE WHEN ('0x' || left(md5(d.doc_id::VARCHAR || ':mix-1'), 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
"""
