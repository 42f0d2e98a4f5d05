"""Importance resampling towards a target's n-grams, whose hashes are composed from the CRCs of words.

A word's CRC-32 is computed once. Since crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where shift appends zero bytes and
is linear over GF(2), the CRC of any run of words follows from those of its words by matrices that shift by powers of
two; no n-gram string exists at any time. Hashed counts of the raw and the target texts give each bucket a gain, and
documents are drawn without replacement by the sum of their mean gain and Gumbel noise seeded by their ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import ASCII_LOWER, small_batches, stored, table

POLYNOMIAL = 0xEDB88320  # CRC-32, reflected
#: Lowers A-Z and turns all other bytes but digits, letters and those of characters beyond ASCII into a space.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in ASCII_LOWER)
#: Words whose CRC is kept for the next text, and bytes of a text cut into words at once.
KNOWN_WORDS, STRETCH = 1 << 19, 1 << 22
#: Gains are floors of 1000 logarithms, so between -50 000 and 50 000; scores add noise of at most 23 000.
UNITS = 1000.0


@cache
def shifts() -> np.ndarray:
    """[k, byte position, byte]: what a CRC's byte becomes when 2^k zero bytes follow; 32 matrices over GF(2) as tables."""
    one = np.array([b for b in range(256)], np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ POLYNOMIAL, one >> 1).astype(np.uint32)
    columns = np.array([(one[(1 << i) & 0xFF] if i < 8 else np.uint32(1 << i - 8)) for i in range(32)], np.uint32)  # images of the unit vectors
    out = np.zeros((32, 4, 256), np.uint32)
    for k in range(32):
        for place in range(4):
            for bit in range(8):
                out[k, place] ^= np.where(np.arange(256) >> bit & 1, columns[8 * place + bit], 0).astype(np.uint32)
        columns = apply_shift(out[k], columns)  # the matrix times itself
    return out


def apply_shift(matrix: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return matrix[0][crcs & 0xFF] ^ matrix[1][crcs >> 8 & 0xFF] ^ matrix[2][crcs >> 16 & 0xFF] ^ matrix[3][crcs >> 24]


def append_zeros(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as its length says."""
    out = crcs.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        chosen = (lengths >> k & 1).astype(bool)
        out[chosen] = apply_shift(shifts()[k], out[chosen])
    return out


def gram_crcs(crcs: np.ndarray, lengths: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
    """For n from low to high the CRCs of all runs of n consecutive words joined by one space."""
    blank = np.full(len(crcs), zlib.crc32(b" "), np.uint32)
    spaced = append_zeros(blank, lengths) ^ crcs  # crc(" " + word)
    grams = crcs
    for n in range(1, high + 1):
        if n > 1:
            grams = append_zeros(grams[:-1], lengths[n - 1 :] + 1) ^ spaced[n - 1 :]
        if n >= low:
            yield grams
        if len(grams) == 0:
            return


class WordCrcs:
    """Words of texts with their CRCs; each different word is hashed once while it is remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(crc, length in bytes) of each word."""
        crcs, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        data, at = (text or "").encode().translate(WORD_BYTES), 0
        while at < len(data):
            end = data.find(b" ", at + STRETCH)
            end = len(data) if end < 0 else end
            found = data[at:end].split()
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            known, crc32 = self.known, zlib.crc32
            for w in set(found).difference(known):
                known[w] = crc32(w)
            crcs.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            at = end
        return np.concatenate(crcs), np.concatenate(lengths)


def bucket_counts(texts: DataFrame, low: int, high: int, buckets: int) -> np.ndarray:
    """How many n-grams of all texts (the one column) fall into each bucket; a vector of fixed size comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = np.zeros(buckets, np.int64), WordCrcs()
        for b in batches:
            for text in b.column(0).to_pylist():
                for grams in gram_crcs(*words(text), low, high):
                    seen += np.bincount(grams % buckets, minlength=buckets)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met])], names=["bucket", "n"])

    out = np.zeros(buckets, object)
    for bucket, n in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1)(S + buckets)) / ((s + 1)(T + buckets)))) of each bucket."""
    n, all_raw, all_target = len(raw), int(sum(raw)), int(sum(target))
    return np.array([math.floor(UNITS * math.log((float(t + 1) * float(all_raw + n)) / (float(s + 1) * float(all_target + n)))) for s, t in zip(raw, target, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, low: int, high: int, seed: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    kind, buckets = docs.schema[id_column].dataType.simpleString(), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCrcs()
        for b in batches:
            sizes, counts, weights = [], [], []
            for t in b.column(1).to_pylist():
                crcs, lengths = words(t)
                n = total = 0
                for grams in gram_crcs(crcs, lengths, low, high):
                    n, total = n + len(grams), total + int(gain[grams % buckets].sum())
                sizes.append(len(crcs)), counts.append(n), weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (sizes, counts, weights)]], names=["id", "n_words", "n_features", "weight"])

    weighed = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-UNITS) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.select("*", (F.col("weight") + noise).cast("long").alias("score")).withColumnRenamed("id", id_column)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, low: int = 1, high: int = 1, buckets: int = 10_000, least: int = 20, seed: str = "2024", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): rank from 1 for the drawn rows, null for all others.

    Of the N rows with at least ``least`` words floor(percent N / 100) are drawn, by score descending, then id ascending
    (null first). Null and empty texts have no feature and weight 0. Rows that repeat an id have the same noise, and each
    is drawn or not by itself; where such rows tie they take ranks in any order. Texts of any length are cut by stretches.
    An empty table gives an empty one; an empty target gives every bucket the weight of its rarity. Other columns are not
    read.

    Only counts come to the driver: by bucket, and by score of the rows that may be drawn (scores are whole numbers
    between -75 000 and 75 000). The latter tell the score down to which rows are sorted and numbered.
    """
    small_batches(docs.sparkSession)
    gain = gains(*[bucket_counts(t.select(F.col(text).alias("text")), low, high, buckets) for t in (docs, target)])
    scored = stored(weigh(docs, gain, low, high, seed, id_column, text), "resampling-scores")
    may = F.col("n_words") >= least
    met = sorted(scored.where(may).groupBy("score").count().collect(), reverse=True)
    wanted, bound, above = sum(n for _, n in met) * percent // 100, None, 0
    for score, n in met:
        if above >= wanted:
            break
        bound, above = score, above + n
    if bound is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = may & (F.col("score") >= bound)
    placed = numbered(scored.where(near), [F.desc("score"), F.asc_nulls_first(id_column)], "rank")
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, drawn towards the words of all benchmark texts; see :func:`resample` for odd rows."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH bits AS (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(b)),
tab AS (SELECT list(v ORDER BY b) AS tab FROM bits),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
raw AS (SELECT row, unnest(words) AS word FROM d), target AS (SELECT unnest(words) AS word FROM b),
forms AS (SELECT DISTINCT word FROM (SELECT word FROM raw UNION ALL SELECT word FROM target)),
coded AS (SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM forms),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM coded, tab),
s AS (SELECT bucket, count(*) AS n FROM raw JOIN hashed USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (word) GROUP BY 1),
gain AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM raw) + 10000)::DOUBLE) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000)::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT row, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM raw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id::VARCHAR), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weighed USING (row)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END::BIGINT AS rank FROM placed
"""
