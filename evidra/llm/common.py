"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import forget, scratch, stored  # noqa: F401 (the operators take them from here)

#: Word separators of every contract: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Lowers A-Z in UTF-8 bytes and leaves all else.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows and bytes in one Arrow batch; texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts takes in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def at_least(counted: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the largest whole numbers in a column, at most so many: all from a bound on, so ties go together.

    Only a histogram comes to the driver, by the highest six bits of the numbers; within one of its steps rows are not
    told apart.
    """
    counted = counted.where(f"{column} > 0")
    power = F.greatest(F.floor(F.log2(F.col(column).cast("double"))) - 5, F.lit(0)).cast("int")
    step = F.expr(f"shiftleft(shiftright(cast({column} as bigint), power), power)")
    found = sorted(counted.withColumn("power", power).groupBy(step.alias("low")).count().collect(), reverse=True)
    bound, held = None, 0
    for low, n in found:
        if (held := held + n) > most:
            break
        bound = low
    return counted.where(F.col(column) >= bound) if bound is not None else counted.limit(0)


def remainder(column: str | Column, m: int) -> Column:
    """crc32 of the value as text, modulo m (null: as the empty text)."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def words(text: str | None) -> list[bytes]:
    """Words of a text as the contracts cut them (bytes split at the same ASCII blanks), A-Z lowered, as UTF-8."""
    return text.encode().translate(ASCII_LOWER).split() if text else []


def draw(id_column: str, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of id and seed."""
    key = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


#: Labels whose shares are broadcast to the rows; with more, a shuffled join.
FEW_LABELS = 50_000


def sampled(rows: DataFrame, label: str, per_label: int, seed: str, id_column: str = "doc_id") -> DataFrame:
    """About per_label rows of each label, chosen by a hash of the id alone; null labels are left out.

    The counts of the labels are joined, not collected, so any number of labels is kept.
    """
    labelled = rows.where(F.col(label).isNotNull())
    counts = stored(labelled.groupBy(F.col(label).alias("_label_of")).agg((F.lit(float(per_label)) / F.count("*")).alias("_label_share")), "label-shares")
    counts = F.broadcast(counts) if counts.count() <= FEW_LABELS else counts
    drawn = labelled.withColumn("_drawn", draw(id_column, seed))
    return drawn.join(counts, (F.col(label) == F.col("_label_of")) & (F.col("_drawn") < F.col("_label_share"))).select(*[F.col(f"`{c}`") for c in rows.columns])


def one_blas_thread() -> None:
    """Keeps numpy's own BLAS, where it can be told so, from starting threads beside Spark's task slots."""
    for lib in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if setter := getattr(ctypes.CDLL(str(lib)), name, None):
                setter(1)
                break
