"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

A text becomes a short vector of statistics (letters, cases, symbols, repeats, lines, compressed size). Random cosines of
the standardised vector approximate a Gaussian kernel. Tasks sum the normal equations of their rows, the sums of all tasks
are added by row of the matrix, and one small system is solved on the driver. The scores are calibrated on rows that the
weights were not learned from: the rows are halved by their vectors, each half is scored by the other's weights, and pool
adjacent violators turns the binned scores into shares of label 1.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, one_blas_thread, remainder, small_batches, stored, table

#: Random features, width of the kernel in standardised units by root of the dimension, and the ridge by row.
FEATURES, WIDTH, RIDGE = 256, 1.0, 1e-4
#: Standardised statistics are cut at so many standard deviations; scores are binned in thousandths from -1 to 2.
CUT, BINS = 6.0, 1000
#: Bytes of a text that are counted at once.
STRETCH = 1 << 22
LETTERS = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
CAPITALS = np.array([0x41 <= b <= 0x5A for b in range(256)])
DIGITS = np.array([0x30 <= b <= 0x39 for b in range(256)])
BLANKS = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
STOPS = np.isin(np.arange(256), list(b".,;:'\"-()"))
CALLS = np.isin(np.arange(256), list(b"!?"))
SYMBOLS = ~(LETTERS | DIGITS | BLANKS | STOPS | CALLS)
KINDS = np.array([LETTERS, CAPITALS, DIGITS, BLANKS, STOPS, CALLS, SYMBOLS], float)
#: Keeps letters and digits, turns blanks into blanks and all else into one mark.
OUTLINE = bytes(0x61 if LETTERS[b] or DIGITS[b] else 0x20 if BLANKS[b] else 0x23 for b in range(256))
SIZE = 22


def _stretches(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def statistics(text: str | None) -> np.ndarray:
    """The vector of a text; zeros for a null or blank one."""
    data, out = (text or "").encode(), np.zeros(SIZE)
    counts, lengths, squares, n_words, same, bare, ends, packed = np.zeros(256), 0, 0, 0, 0, 0, 0, 0
    seen: Counter[bytes] = Counter()
    before = b""
    for part in _stretches(data):
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        found, outlines = part.split(), part.translate(OUTLINE).split()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n_words, lengths, squares = n_words + len(found), lengths + int(sizes.sum()), squares + int((sizes * sizes).sum())
        seen.update(found)
        same += sum(a == b for a, b in pairwise([before, *found]))
        before = found[-1] if found else before
        bare += sum(b"a" not in o for o in outlines)
        ends += sum(o[-2:] == b"##" for o in outlines)
        packed += len(zlib.compress(part, 1))
    if not n_words:
        return out
    n = len(data)
    kinds = KINDS @ counts
    shares = counts[counts > 0] / n
    lines = Counter(x for x in data.split(b"\n") if x.strip())
    n_lines = lines.total()
    mean = lengths / n_words
    out[:7] = kinds / n
    out[7] = kinds[1] / max(1.0, kinds[0])
    out[8] = -float((shares * np.log2(shares)).sum())
    out[9], out[10] = mean, math.sqrt(max(0.0, squares / n_words - mean * mean))
    out[11] = len(seen) / n_words
    out[12] = len(seen) / math.sqrt(n_words)
    out[13] = seen.most_common(1)[0][1] / n_words if n_words else 0.0
    out[14], out[15], out[16] = same / n_words, bare / n_words, ends / n_words
    out[17] = math.log1p(n_words)
    out[18] = math.log1p(n / n_lines)
    out[19] = len(lines) / n_lines
    out[20] = max(lines.values()) / n_lines if n_lines > 2 else 0.0
    out[21] = packed / n
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    shares: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores in [0, 1] of vectors of statistics."""
        if not len(self.weights):
            return np.full(len(x), self.shares[0])
        return np.interp(cosines(x, self.mean, self.scale) @ self.weights, self.knots, self.shares)


def cosines(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant; the same directions everywhere."""
    drawn = np.random.default_rng(20_240)
    directions = drawn.standard_normal((SIZE, features)) / (WIDTH * math.sqrt(SIZE))
    phases = drawn.uniform(0, 2 * math.pi, features)
    z = np.clip((x - mean) / scale, -CUT, CUT)
    return np.column_stack([math.sqrt(2 / features) * np.cos(z @ directions + phases), np.ones(len(x))])


def pooled(hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (place, share) of the blocks of a sequence of bins that make the shares non-decreasing."""
    blocks: list[list[float]] = []  # hits, n, sum of places
    for k in np.flatnonzero(n > 0):
        blocks.append([float(hits[k]), float(n[k]), float(n[k] * k)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the statistics of every row as bytes of doubles."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "x"])

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, SIZE)


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the vectors (key, v) that tasks emit, added key by key in tasks; only the sums come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v, float)
                sums[key] = sums[key] + v if key in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["key", "v"])

    schema = "key int, v binary"
    return {r["key"]: np.frombuffer(r["v"], float) for r in parts.repartition("key").sortWithinPartitions("key", "v").mapInArrow(add, schema).collect()}


def _vectors(keys: list[int], rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["key", "v"])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id") -> QualityModel:
    """Learns from all labelled rows of ``measured`` docs; nothing is sampled.

    Null labels and ids are left out, repeated ids count with their largest label. Rows with equal statistics and labels
    (copies among them) count once. Without labels every score is 0.5; with one kind of label it is that label.
    """
    given = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_labelled")).agg((F.max(label) > 0).cast("double").alias("y"))
    half = F.pmod(F.xxhash64("x"), F.lit(2)).cast("int").alias("half")
    rows = stored(stats.join(given, F.col("id") == F.col("_labelled")).select("x", "y").distinct().select("x", "y", half), "quality-rows")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, SIZE))
        for b in batches:
            x = _matrix(b.column(0))
            sums += [x.sum(axis=0), (x * x).sum(axis=0), np.append([len(x), sum(b.column(1).to_pylist())], np.zeros(SIZE - 2))]
        yield _vectors([0, 1, 2], sums)

    sums = _summed(rows.mapInArrow(moments, "key int, v binary"))
    n, ones = sums[2][:2] if sums else (0.0, 0.0)
    mean = sums[0] / max(1.0, n) if sums else np.zeros(SIZE)
    scale = np.sqrt(np.maximum(sums[1] / max(1.0, n) - mean * mean, 0)) if sums else np.ones(SIZE)
    scale = np.where(scale > 1e-9, scale, 1.0)
    if ones in (0, n):
        forget(rows)
        return QualityModel(mean, scale, np.zeros(0), np.zeros(1), np.array([ones / n if n else 0.5]))
    wide = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        own = np.zeros((2, wide, wide + 1))
        for b in batches:
            z, y, halves = cosines(_matrix(b.column(0)), mean, scale), b.column(1).to_numpy(), b.column(2).to_numpy()
            for h in (0, 1):
                part = z[halves == h]
                own[h] += part.T @ np.column_stack([part, y[halves == h]])
        yield _vectors(list(range(2 * wide)), own.reshape(2 * wide, wide + 1))

    met = _summed(rows.mapInArrow(equations, "key int, v binary"))
    system = np.stack([met[k] for k in range(2 * wide)]).reshape(2, wide, wide + 1)

    def solved(a: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a[:, :-1] + RIDGE * max(1.0, a[-1, -2]) * np.eye(wide), a[:, -1])

    weights, others = solved(system.sum(axis=0)), [solved(system[1]), solved(system[0])]

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((2, 3 * BINS + 1))
        for b in batches:
            z, y, halves = cosines(_matrix(b.column(0)), mean, scale), b.column(1).to_numpy(), b.column(2).to_numpy()
            raw = np.where(halves == 0, z @ others[0], z @ others[1])
            place = np.rint(np.clip(raw + 1, 0, 3) * BINS).astype(int)
            bins += [np.bincount(place, y, 3 * BINS + 1), np.bincount(place, minlength=3 * BINS + 1)]
        yield _vectors([0, 1], bins)

    found = _summed(rows.mapInArrow(unseen, "key int, v binary"))
    places, shares = pooled(found[0], found[1])
    forget(rows)
    return QualityModel(mean, scale, weights, places / BINS - 1, shares)


def score(stats: DataFrame, model: QualityModel, least: float = 0.3, id_column: str = "doc_id") -> DataFrame:
    """(id, score, predicted) of every row of ``measured`` docs: the calibrated share of label 1, and whether it is ``least`` or more.

    Null and empty texts are scored like any other, by a vector of zeros. Rows that repeat an id are scored each; equal
    texts score alike, so ties stay ties. An empty table gives an empty one; other columns are not read.
    """
    kind = stats.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for b in batches:
            got = model.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64()), pa.array((got >= least).astype(np.int32))], names=["id", "score", "predicted"])

    return stats.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; learns from the labels of ids whose crc32 modulo 5 is not 0; see :func:`score` for odd rows."""
    stats = stored(measured(table(spark, sf_dir, "documents")), "quality-statistics")
    model = fit(stats, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return score(stats, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
