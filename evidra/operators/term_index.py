"""A positional inverted index: which texts hold a term, all terms or a phrase, without reading the texts again.

Postings are rows of (term, range of ids): ids and places as differences in variable-length bytes. A term that every text
holds has one row for each range, so no row grows with the corpus. Each file is in the order of its terms, so that a lookup
reads the row groups of its terms alone.

A query term matches anywhere in a text, case ignored, as in a plain search: its first word may be the end of a longer
one, its last the beginning. The words of the vocabulary that fit each place are looked up, their places are intersected,
and only where signs between words or at the ends matter the texts found are read to confirm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import named, stored

WORD = re.compile(r"[^\W_]+")
#: Ids of a range are alike but for so many bits; postings of one row are at most 2^RANGE_BITS.
RANGE_BITS = 14
#: Words of a lookup that are named in the scan's filter; with more, the scan is filtered by the join alone.
NAMED_WORDS = 1000


def packed(values: np.ndarray, starts: np.ndarray | None = None) -> list[bytes]:
    """Whole numbers from 0 on, seven bits a byte, the last byte of each without its high bit; one string for each start."""
    values = np.asarray(values, np.uint64)
    starts = np.zeros(1, int) if starts is None else starts
    if not len(values):
        return [b""] * len(starts)
    sizes = np.ones(len(values), int)
    for k in range(1, 10):
        if (more := values >= np.uint64(1 << 7 * k)).any():
            sizes += more
        else:
            break
    ends = np.cumsum(sizes)
    which = np.repeat(np.arange(len(values)), sizes)
    shift = np.arange(ends[-1]) - (ends - sizes)[which]
    out = (values[which] >> (7 * shift).astype(np.uint64) & np.uint64(127)).astype(np.uint8)
    out[shift < sizes[which] - 1] |= 128
    data, cuts = out.tobytes(), (ends - sizes)[starts].tolist()
    return [data[x:y] for x, y in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), first).astype(np.int64)


def differences(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Steps from value to value, counted anew from 0 at each start."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


@dataclass
class TermIndex:
    postings: DataFrame
    vocabulary: DataFrame


#: Rows and bytes of one Arrow batch that a task hands on.
ROWS, BYTES = 1 << 16, 16 << 20


class _Rows:
    """Columns that grow and are handed on in batches."""

    def __init__(self, **kinds: pa.DataType) -> None:
        self.kinds, self.columns, self.bytes = kinds, {c: [] for c in kinds}, 0

    def full(self) -> bool:
        return self.bytes >= BYTES or len(next(iter(self.columns.values()))) >= ROWS

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.columns[c], k) for c, k in self.kinds.items()], names=list(self.kinds))
        self.columns, self.bytes = {c: [] for c in self.kinds}, 0
        return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, doc, n, places) of every different word of every text."""
    out = _Rows(term=pa.string(), doc=pa.int64(), n=pa.int64(), places=pa.binary())
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = WORD.findall((text or "").lower())
            if not words:
                continue
            known: dict[str, int] = {}
            code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
            ends = np.append(cuts[1:], len(order))
            own = packed(differences(order, cuts), cuts)
            for column, values in zip(out.columns.values(), (list(known), [doc] * len(known), (ends - cuts).tolist(), own), strict=True):
                column.extend(values)
            out.bytes += len(text)
            if out.full():
                yield out.batch()
    yield out.batch()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (term, range) in the sorted stream as one row each."""
    term, docs, counts, places = None, [], [], []
    out = _Rows(term=pa.string(), range=pa.int64(), docs=pa.int64(), n=pa.int64(), ids=pa.binary(), counts=pa.binary(), places=pa.binary())

    ids: list[int] = []
    sizes: list[int] = []

    def close() -> None:
        for column, value in zip(out.columns.values(), (term[0], term[1], len(docs), sum(counts)), strict=False):
            column.append(value)
        out.columns["counts"].extend(counts)
        out.columns["places"].append(b"".join(places))
        ids.extend(docs), sizes.append(len(docs))
        out.bytes += len(out.columns["places"][-1]) + 3 * len(docs)

    def batch() -> pa.RecordBatch:
        """The ids and counts of all rows are packed at once."""
        starts = np.cumsum(sizes, dtype=int) - np.array(sizes, int)
        first = np.repeat(np.array(out.columns["range"], np.int64), sizes) << RANGE_BITS
        out.columns["ids"] = packed(differences(np.array(ids, np.int64) - first, starts), starts) if sizes else []
        out.columns["counts"] = packed(np.array(out.columns["counts"], np.int64), starts) if sizes else []
        ids.clear(), sizes.clear()
        return out.batch()

    for b in batches:
        for t, r, d, n, p in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (t, r) != term:
                if term is not None:
                    close()
                if out.full():
                    yield batch()
                term, docs, counts, places = (t, r), [], [], []
            docs.append(d), counts.append(n), places.append(p)
    if term is not None:
        close()
    yield batch()


def build_terms(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> TermIndex:
    """Writes the index of all words of all texts to ``path``. ``doc`` is a whole number that tells texts apart (null ones have no entry)."""
    spark = docs.sparkSession
    found = docs.where(named(doc).isNotNull()).select(named(doc).cast("long").alias("doc"), named(text).alias("text")).mapInArrow(_places, "term string, doc long, n long, places binary")
    ranged = found.select("term", F.shiftright("doc", RANGE_BITS).alias("range"), "doc", "n", "places").repartition("term", "range").sortWithinPartitions("term", "range", "doc")
    rows = ranged.mapInArrow(_joined, "term string, range long, docs long, n long, ids binary, counts binary, places binary")
    rows.write.option("compression", "zstd").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).write.parquet(f"{path}/vocabulary")
    return open_terms(spark, path)


def open_terms(spark: SparkSession, path: str) -> TermIndex:
    return TermIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"))


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(no, slot, doc, place) of postings; the place of a single word does not matter and is 0."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if k < 2 else np.int64)) for k, c in enumerate(columns)], names=["no", "slot", "doc", "place"])

    for b in batches:
        for no, slot, phrase, r, ids, counts, places in zip(*[c.to_pylist() for c in b.columns], strict=True):
            docs = np.cumsum(unpacked(ids)) + (r << RANGE_BITS)
            at = np.zeros(len(docs), np.int64)
            if phrase:
                n, steps = unpacked(counts), unpacked(places)
                total, first = np.cumsum(steps), np.cumsum(n) - n
                at = total - np.repeat(total[first] - steps[first], n)  # places count anew in every text
                docs = np.repeat(docs, n)
            parts.append((np.full(len(docs), no), np.full(len(docs), slot), docs, at))
            held += len(docs)
            if held >= ROWS:
                yield batch()
                parts, held = [], 0
    yield batch()


def holding(index: TermIndex, docs: DataFrame, terms: Sequence[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(no, doc): the texts that hold the term of that number anywhere, case ignored; every pair once.

    A term without any word is sought in all texts. Null texts hold nothing. Rows that repeat an id count as one text.
    """
    pieces = [WORD.findall(t.lower()) for t in terms]
    word = F.col("term")
    fits, scans, read = [], [], []
    for no, (term, parts) in enumerate(zip(terms, pieces, strict=True)):
        if not parts:
            scans.append(no)
            continue
        if len(parts) > 1 or parts[0] != term.lower():
            read.append(no)  # the signs around the words are to be confirmed
        for slot, part in enumerate(parts):
            open_left, open_right = slot == 0 and term.lower().startswith(part), slot == len(parts) - 1 and term.lower().endswith(part)
            hit = F.contains(word, F.lit(part)) if open_left and open_right else F.endswith(word, F.lit(part)) if open_left else F.startswith(word, F.lit(part)) if open_right else word == part
            fits.append(F.when(hit, F.struct(F.lit(no).alias("no"), F.lit(slot).alias("slot"), F.lit(len(parts) > 1).alias("phrase"))))
    out = docs.sparkSession.createDataFrame([], "no int, doc long")
    if fits:
        asked = stored(index.vocabulary.select("term", F.explode(F.array_compact(F.array(*fits))).alias("of")).select("term", "of.*"), "asked-words")
        few = asked.select("term").distinct().limit(NAMED_WORDS + 1).collect()
        postings = index.postings.where(F.col("term").isin([r[0] for r in few])) if len(few) <= NAMED_WORDS else index.postings
        rows = postings.join(asked, "term").select("no", "slot", "phrase", "range", "ids", "counts", "places").mapInArrow(_unfold, "no int, slot int, doc long, place long")
        sizes = F.array(*[F.lit(len(p)) for p in pieces])
        together = rows.groupBy("no", "doc", (F.col("place") - F.col("slot")).alias("start")).agg(F.count_distinct("slot").alias("slots"))
        out = together.where(F.col("slots") == F.element_at(sizes, F.col("no") + 1)).select("no", "doc").distinct()
    low = F.lower(F.coalesce(named(text), F.lit("")))
    listed = F.array(*[F.lit(t.lower()) for t in terms])
    keyed = docs.where(named(doc).isNotNull()).select(named(doc).cast("long").alias("doc"), low.alias("_low"))
    if read:
        sure = out.where(~F.col("no").isin(read))
        checked = out.where(F.col("no").isin(read)).join(keyed, "doc").where(F.contains(F.col("_low"), F.element_at(listed, F.col("no") + 1)))
        out = sure.unionByName(checked.select("no", "doc").distinct())
    if scans:
        every = keyed.select("doc", "_low", F.explode(F.array(*[F.lit(no) for no in scans])).alias("no"))
        out = out.unionByName(every.where(F.contains(F.col("_low"), F.element_at(listed, F.col("no") + 1))).select("no", "doc").distinct())
    return out


def inspect(index: TermIndex, docs: DataFrame, terms: Sequence[str], doc: str, text: str, year: Column, document: Column, samples: int = 5, together: bool = False, width: int = 180) -> DataFrame:
    """(term, year, chunks, documents, docs, snippets): texts and documents that hold the term, and the first few by id with
    the text around the term.

    With ``together`` only texts that hold all terms, as one term that joins them by " + ", shown around the first.
    Counts need the ids alone; texts are read for the samples only. Years without a hit have no row.
    """
    hits = holding(index, docs, terms, doc, text)
    if together:
        hits = hits.groupBy("doc").agg(F.count("*").alias("_n")).where(F.col("_n") == len(terms)).select(F.lit(0).alias("no"), "doc")
    hits = stored(hits, "term-hits")
    about = docs.where(named(doc).isNotNull()).select(named(doc).cast("long").alias("doc"), year.alias("year"), document.alias("document"))
    known = hits.join(about, "doc")
    counts = known.groupBy("no", "year").agg(F.count("*").alias("chunks"), F.count_distinct("document").alias("documents"))
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy("no", "year").orderBy("doc"))).where(F.col("_n") <= samples)
    shown = F.array(*[F.lit(t) for t in terms])
    texts = docs.select(named(doc).cast("long").alias("doc"), named(text).alias("_text"))
    snippets = first.join(texts, "doc").select("no", "year", F.struct("doc", F.trim(F.translate(T.snippet(F.col("_text"), F.element_at(shown, F.col("no") + 1), width), "\n", " ")).alias("snippet")).alias("sample"))
    held = snippets.groupBy(F.col("no").alias("_no"), F.col("year").alias("_year")).agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    name = F.lit(" + ".join(terms)) if together else F.element_at(shown, F.col("no") + 1)
    listed = lambda field, kind: F.coalesce(F.transform("samples", lambda x: x[field]), F.array().cast(kind)).alias(f"{field}s")
    both = counts.join(held, (F.col("no") == F.col("_no")) & F.col("year").eqNullSafe(F.col("_year")), "left")
    return both.select(name.alias("term"), "year", "chunks", "documents", listed("doc", "array<bigint>"), listed("snippet", "array<string>"))
