"""Exact and indexed search among vectors: blocks of questions times blocks of chunks.

Chunks stay where they are. A bounded block of question vectors is broadcast, every Arrow batch of chunks is multiplied
with it as one matrix product, and only the best of each question and group leave the task.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import forget, free_name, named, stored

#: Bytes of question vectors that are sent to every task at once; more questions take more passes over the chunks.
QUESTION_BYTES = 64 << 20
#: Questions of one matrix product, and results held in a task before those out of place are dropped.
QUESTION_BLOCK, HELD = 1024, 1 << 20
#: Scores of one matrix product with the rows of a cell.
PRODUCT = 1 << 20
#: Scores are rounded to so many digits before they are ranked, so that ties are ties everywhere.
DIGITS = 6


def one_thread() -> None:
    """Keeps numpy's matrix products from starting threads beside Spark's task slots."""
    for lib in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if setter := getattr(ctypes.CDLL(str(lib)), name, None):
                setter(1)
                break


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the vectors of a list column divided by their lengths, and which rows they are of.

    Null vectors and those with null or non-finite components are left out; a zero vector stays.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths > 0)
    if not len(rows):
        return rows, np.zeros((0, 0))
    size = int(lengths[rows[0]])
    if (lengths[rows] != size).any():
        raise ValueError("vectors differ in length")
    flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
    matrix = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
    sound = np.isfinite(matrix).all(axis=1)
    rows, matrix = rows[sound], matrix[sound]
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return rows, matrix / np.where(norm > 0, norm, 1.0)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row; of equal ones the first columns."""
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above, equal = scores > least, scores == least
        return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))))
    return np.nonzero(np.ones(scores.shape, bool))


def _codes(columns: Sequence[pa.Array], known: dict[tuple, int]) -> np.ndarray:
    """One number for each distinct row of the columns; known gives the numbers of rows met before."""
    if not columns:
        known.setdefault((), 0)
        return np.zeros(0, int)
    places = [c.dictionary_encode(null_encoding="encode") for c in columns]
    mixed = np.zeros(len(columns[0]), np.int64)
    for p in places:
        mixed = mixed * (len(p.dictionary) + 1) + p.indices.to_numpy(zero_copy_only=False)
    _, first, inverse = np.unique(mixed, return_index=True, return_inverse=True)
    rows = list(zip(*[c.take(pa.array(first)).to_pylist() for c in columns], strict=True))
    return np.array([known.setdefault(r, len(known)) for r in rows], int)[inverse]


class Tops:
    """The best k results of each (question, group) that a task has met."""

    def __init__(self, k: int, kind: pa.DataType) -> None:
        self.k, self.kind, self.parts, self.rows, self.bound = k, kind, [], 0, HELD

    def add(self, question: np.ndarray, group: np.ndarray, chunk: pa.Array, score: np.ndarray) -> None:
        self.parts.append(pa.table({"question": question, "group": group, "score": score, "chunk": chunk}))
        self.rows += len(question)
        if self.rows >= self.bound:
            self.parts = [self.pruned()]
            self.rows = self.parts[0].num_rows
            self.bound = max(HELD, 2 * self.rows)

    def pruned(self) -> pa.Table:
        t = pa.concat_tables(self.parts).combine_chunks().sort_by([("question", "ascending"), ("group", "ascending"), ("score", "descending"), ("chunk", "ascending")])
        q, g = t["question"].to_numpy(), t["group"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (g[1:] != g[:-1])]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return t.filter(pa.array(place < self.k))


def _pass(chunks: DataFrame, asked: pa.Table, keys: Sequence[str], k: int, vector: str, query_vector: str, chunk: str, per: Sequence[str], schema: T.StructType) -> DataFrame:
    """One pass over the chunks for a bounded table of questions."""
    sent = chunks.sparkSession.sparkContext.broadcast(asked)
    others = [c for c in asked.column_names if c != query_vector]
    own = list(dict.fromkeys([*keys, *per]))
    read = chunks.select(*[named(c) for c in dict.fromkeys([*own, chunk, vector])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        table = sent.value
        held, matrix = unit_rows(table[query_vector])
        by_key: dict[tuple, int] = {}
        key_of = _codes([table[c].combine_chunks().take(pa.array(held)) for c in keys], by_key) if keys else np.zeros(len(held), int)
        groups: dict[tuple, int] = {}
        tops: Tops | None = None
        for b in batches:
            rows, vectors = unit_rows(b.column(b.schema.get_field_index(vector)))
            if not len(rows) or not len(held):
                continue
            if vectors.shape[1] != matrix.shape[1]:
                raise ValueError("questions and chunks differ in length")
            tops = tops or Tops(k, b.column(b.schema.get_field_index(chunk)).type)
            ids = b.column(b.schema.get_field_index(chunk)).take(pa.array(rows))
            part = _codes([b.column(b.schema.get_field_index(c)).take(pa.array(rows)) for c in per], groups) if per else np.zeros(len(rows), int)
            known = dict(by_key) if keys else {}
            key = _codes([b.column(b.schema.get_field_index(c)).take(pa.array(rows)) for c in keys], known) if keys else np.zeros(len(rows), int)
            order = pc.sort_indices(pa.table({"key": key, "part": part, "id": ids}), sort_keys=[("key", "ascending"), ("part", "ascending"), ("id", "ascending")]).to_numpy()
            key, part, vectors, ids = key[order], part[order], vectors[order], ids.take(pa.array(order))
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
                mine = np.flatnonzero(key_of == key[a]) if keys else np.arange(len(held))
                for at in range(0, len(mine), QUESTION_BLOCK):
                    block = mine[at : at + QUESTION_BLOCK]
                    scores = np.round(matrix[block] @ vectors[a:z].T, DIGITS) + 0.0
                    q, c = best_of(scores, k)
                    tops.add(block[q], np.full(len(q), part[a]), ids.take(pa.array(a + c)), scores[q, c])
        if tops and tops.parts:
            t = tops.pruned()
            rows = pa.array(held[t["question"].to_numpy()])
            listed = list(groups)
            columns = {c: table[c].combine_chunks().take(rows) for c in others}
            for k_, c in enumerate(per):
                if c not in columns:
                    kind = read_types[c]
                    columns[c] = pa.array([g[k_] for g in listed], kind).take(t["group"].combine_chunks())
            columns |= {chunk: t["chunk"].combine_chunks(), "score": t["score"].combine_chunks()}
            yield from pa.table(columns).to_batches(max_chunksize=1 << 16)

    read_types = {f.name: _arrow(f.dataType) for f in read.schema.fields}
    return read.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def top_k(chunks: DataFrame, questions: DataFrame, keys: Sequence[str], k: int, vector: str = "vector", query_vector: str = "query_vector", chunk: str = "chunk_id", per: Sequence[str] = ()) -> DataFrame:
    """(questions' columns but the vector, per..., chunk, score, rank): exact top k by cosine among chunks equal on keys.

    The filter comes before the ranking, so no candidate is lost to it. With ``per``, k chunks for each of its values.
    Scores are rounded to six digits; ties go to the smaller chunk. Null vectors, or with null components, find nothing
    and are not found; null keys meet nothing; rows that repeat are each ranked. Empty tables give an empty one. No pair
    of question and chunk leaves its task unless it is among the task's k best of its question and group.
    """
    others = [c for c in questions.columns if c != query_vector]
    groups = list(dict.fromkeys([*others, *per]))
    kinds = {f.name: f for f in [*questions.schema.fields, *chunks.schema.fields]}
    schema = T.StructType([*[T.StructField(c, kinds[c].dataType) for c in groups], T.StructField(chunk, chunks.schema[chunk].dataType), T.StructField("score", T.DoubleType())])
    for c in keys:
        questions, chunks = questions.where(named(c).isNotNull()), chunks.where(named(c).isNotNull())
    n, size = questions.agg(F.count("*"), F.max(F.size(query_vector))).first()
    passes = max(1, -(-n * 8 * max(1, size or 1) // QUESTION_BYTES))
    deal = F.pmod(F.xxhash64(*[named(c) for c in others]), F.lit(passes))
    found: DataFrame | None = None
    for p in range(passes):
        asked = (questions.where(deal == p) if passes > 1 else questions).toArrow()
        one = _pass(chunks, asked, keys, k, vector, query_vector, chunk, per, schema)
        found = one if found is None else found.unionByName(one)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*[named(c) for c in groups]).orderBy(F.desc("score"), chunk)))
    return ranked.where(F.col("rank") <= k)


@dataclass
class VectorIndex:
    """An inverted file of vectors: ``data`` has every row with its cell, ``cells`` the centroid, rows and reach of each."""

    data: DataFrame
    cells: DataFrame


#: Rows that centroids are learned from, rounds of learning, and cells at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 4096
#: Candidates that are looked at before a question with too few hits asks for more.
GROWTH = (100, 300, 1000, 3000, 10_000)


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of a sample of unit vectors, by rounds of nearest centroid and mean direction."""
    found = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([np.argmax(sample[a : a + 4096] @ found.T, axis=1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        found = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), found)
    return found


def build_index(chunks: DataFrame, path: str, cells: int | None = None, vector: str = "vector", chunk: str = "chunk_id", sample: int = SAMPLE) -> VectorIndex:
    """Writes the index to ``path``: every row of chunks with a sound vector, in the folder of its nearest centroid.

    Centroids are learned from about ``sample`` rows that a hash of the chunk's id picks; there are as many as the root of
    the rows unless told, at most MOST_CELLS. Every row is placed. A cell of many rows is written by several tasks.
    """
    spark = chunks.sparkSession
    n = chunks.where(named(vector).isNotNull()).count()
    cells = min(MOST_CELLS, cells or max(1, round(n**0.5)))
    share = min(1.0, sample / max(1, n))
    drawn = chunks.where(F.pmod(F.xxhash64(named(chunk)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).select(named(vector))
    _, learned = unit_rows(drawn.toArrow()[vector])
    centres = centroids(learned, min(cells, len(learned))) if len(learned) else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast(centres)
    fields = chunks.schema.fields
    schema = T.StructType([*fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            rows, vectors = unit_rows(b.column(b.schema.get_field_index(vector)))
            if len(rows):
                near = vectors @ sent.value.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                columns = [c.take(pa.array(rows)) for c in b.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    placed = stored(chunks.mapInArrow(place, schema), "index-placed")
    dealt = placed.repartitionByRange(F.col("cell"), F.xxhash64(named(chunk)))  # few files: a cell is in one task, or in those next to each other
    dealt.write.partitionBy("cell").option("compression", "zstd").parquet(f"{path}/data")
    forget(placed)
    data = spark.read.schema(schema).parquet(f"{path}/data")
    rows = [(k, c.tolist()) for k, c in enumerate(centres)]
    reach = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach"))
    spark.createDataFrame(rows, "cell int, centre array<double>").join(F.broadcast(reach), "cell").coalesce(1).write.parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/cells"))


def _near_cells(index: VectorIndex) -> Any:
    """A broadcast of the cells that hold rows: number, centroid, rows and reach of each, by number."""
    cells = index.cells.orderBy("cell").toArrow()
    return index.data.sparkSession.sparkContext.broadcast((cells["cell"].to_numpy(), unit_rows(cells["centre"])[1], cells["n"].to_numpy(), cells["reach"].to_numpy()))


def _bound(near: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The best cosine that a row of a cell can have, by the cosine with its centroid and the cell's reach."""
    return np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - reach))


def _probes(questions: DataFrame, index: VectorIndex, query_vector: str, within: int | None = None) -> DataFrame:
    """Each question with every cell: closeness, rows of the cells before it, and the best cosine a row there can have.

    With ``within``, only cells that fewer rows are before.
    """
    sent = _near_cells(index)
    others = [f for f in questions.schema.fields if f.name != query_vector]
    schema = T.StructType([*others, *[T.StructField(c, k) for c, k in (("cell", T.IntegerType()), ("ahead", T.LongType()), ("bound", T.DoubleType()), ("near", T.DoubleType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        cell, centres, n, reach = sent.value
        for b in batches:
            rows, vectors = unit_rows(b.column(b.schema.get_field_index(query_vector)))
            for at in range(0, len(rows) if len(cell) else 0, 256):
                near = vectors[at : at + 256] @ centres.T
                order = np.argsort(-near, axis=1, kind="stable")
                ahead = np.cumsum(n[order], axis=1) - n[order]
                near = np.take_along_axis(near, order, 1)
                q, c = np.nonzero(ahead < (within if within is not None else n.sum() + 1))
                of = pa.array(rows[at : at + 256][q])
                columns = [x.take(of) for x, name in zip(b.columns, b.schema.names, strict=True) if name != query_vector]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell[order[q, c]].astype(np.int32)), pa.array(ahead[q, c]), pa.array(_bound(near[q, c], reach[order[q, c]])), pa.array(near[q, c])], names=[f.name for f in schema.fields])

    return questions.mapInArrow(run, schema)


def _reached(questions: DataFrame, cells: Any, query_vector: str, floor: str) -> list[int]:
    """The cells that may hold a row as good as some question's floor (null: any row); at most MOST_CELLS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        cell, centres, _, reach = cells.value
        met = np.zeros(len(cell), bool)
        for b in batches:
            rows, vectors = unit_rows(b.column(0))
            least = pc.fill_null(b.column(1), -2.0).to_numpy(zero_copy_only=False)[rows]
            for at in range(0, len(rows) if len(cell) else 0, 256):
                met |= (_bound(vectors[at : at + 256] @ centres.T, reach) >= least[at : at + 256, None]).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(cell[met].astype(np.int32), pa.int32())], names=["cell"])

    return [r[0] for r in questions.select(named(query_vector), named(floor)).mapInArrow(run, "cell int").distinct().collect()]


def _cells_pass(data: DataFrame, cells: Any, asked: pa.Table, keys: Sequence[str], k: int, vector: str, query_vector: str, chunk: str, cut: str, floor: str, schema: T.StructType) -> DataFrame:
    """One pass over the rows of the cells for a bounded table of questions; each question's k best of every task.

    A question looks at the cells at least as close as its cut, or, where that is null, at those that may hold a row as
    good as its floor. Rows below the floor are left out (null: none); it rises with what the task has met, so that
    nearly all pairs cost their product and one comparison.
    """
    sent = data.sparkSession.sparkContext.broadcast(asked)
    read = data.select(*[named(c) for c in dict.fromkeys([*keys, chunk, vector, "cell"])])
    slack = 10.0**-DIGITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        table, (numbers, centres, _, reach) = sent.value, cells.value
        held, matrix = unit_rows(table[query_vector])
        of = table.take(pa.array(held))
        by_key: dict[tuple, int] = {}
        key_of = _codes([of[c].combine_chunks() for c in keys], by_key) if keys else np.zeros(len(held), int)
        least = pc.fill_null(of[floor].combine_chunks(), -2.0).to_numpy(zero_copy_only=False).copy()
        closest = pc.fill_null(of[cut].combine_chunks(), -3.0).to_numpy(zero_copy_only=False)
        asking = [np.flatnonzero(key_of == code) for code in range(len(by_key) if keys else 1)]
        tops: Tops | None = None

        def take(place: int, mine: np.ndarray, vectors: np.ndarray, ids: pa.Array) -> None:
            near = matrix[mine] @ centres[place]
            wanted = np.where(closest[mine] > -3, near >= closest[mine] - 1e-12, _bound(near, reach[place]) >= least[mine])
            mine = mine[wanted]
            step = max(1, min(QUESTION_BLOCK, PRODUCT // len(vectors)))
            for at in range(0, len(mine), step):
                block = mine[at : at + step]
                raw = matrix[block] @ vectors.T
                q, c = np.nonzero(raw >= least[block, None])
                if len(q) > k * len(block):  # more than the best k of each: they raise the floors
                    rounded = np.round(raw, DIGITS) + 0.0
                    q, c = best_of(rounded, k)
                    least[block] = np.maximum(least[block], rounded[q, c].reshape(len(block), k).min(axis=1) - slack)
                if len(q):
                    tops.add(block[q], np.zeros(len(q), int), ids.take(pa.array(c)), np.round(raw[q, c], DIGITS) + 0.0)

        for b in batches:
            rows, vectors = unit_rows(b.column(b.schema.get_field_index(vector)))
            if not len(rows) or not len(held):
                continue
            if vectors.shape[1] != matrix.shape[1]:
                raise ValueError("questions and chunks differ in length")
            b = b.take(pa.array(rows))
            ids, cell = b.column(b.schema.get_field_index(chunk)), b.column(b.schema.get_field_index("cell")).to_numpy()
            tops = tops or Tops(k, ids.type)
            key = _codes([b.column(b.schema.get_field_index(c)) for c in keys], dict(by_key)) if keys else np.zeros(len(rows), int)
            order = pc.sort_indices(pa.table({"key": key, "cell": cell, "id": ids}), sort_keys=[("key", "ascending"), ("cell", "ascending"), ("id", "ascending")]).to_numpy()
            key, cell, vectors, ids = key[order], cell[order], vectors[order], ids.take(pa.array(order))
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
                if key[a] < len(asking) and len(asking[key[a]]):
                    take(int(np.searchsorted(numbers, cell[a])), asking[key[a]], vectors[a:z], ids.slice(a, z - a))
        if tops and tops.parts:
            t = tops.pruned()
            rows = pa.array(t["question"].to_numpy())
            columns = {f.name: of[f.name].combine_chunks().take(rows) for f in schema.fields[:-2]}
            columns |= {chunk: t["chunk"].combine_chunks(), "score": t["score"].combine_chunks()}
            yield from pa.table(columns).to_batches(max_chunksize=1 << 16)

    return read.mapInArrow(run, schema)


def indexed_top_k(index: VectorIndex, questions: DataFrame, ids: Sequence[str], keys: Sequence[str], k: int, sure: bool = False, growth: Sequence[int] = GROWTH, vector: str = "vector", query_vector: str = "query_vector", chunk: str = "chunk_id") -> DataFrame:
    """(ids..., keys..., chunk, score, rank): top k among the rows equal on keys, cell by cell from the nearest on.

    Each question looks at the cells that hold about the first number of candidates in ``growth``, and, while it has fewer
    than k hits after the filter, at those that hold the next number. With ``sure`` it looks at the last number at once;
    then all cells that may hold a row as good as its k-th (by the angle between question and centroid and the reach of
    the cell) are searched, so the result is that of an exact search. ``ids`` tell questions apart. Each question is sent
    once a step, in blocks of at most QUESTION_BYTES; only cells that some question asks for are read.
    """
    spark = questions.sparkSession
    cols = [*ids, *keys]
    for c in keys:
        questions = questions.where(named(c).isNotNull())
    questions = stored(questions.select(*[named(c) for c in cols], named(query_vector)), "index-questions")
    cells = _near_cells(index)
    kinds = {f.name: f.dataType for f in questions.schema.fields}
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in cols], T.StructField(chunk, index.data.schema[chunk].dataType), T.StructField("score", T.DoubleType())])
    cut, floor, rank = (free_name(c, questions, index.data) for c in ("cut", "floor", "rank"))
    best = Window.partitionBy(*[named(c) for c in ids]).orderBy(F.desc("score"), chunk)

    def searched(asked: DataFrame, wanted: list[int]) -> DataFrame | None:
        """The best of the questions (with cut and floor) among the wanted cells."""
        n, size = asked.agg(F.count("*"), F.max(F.size(query_vector))).first()
        if not n or not wanted:
            return None
        passes = -(-n * 8 * max(1, size or 1) // QUESTION_BYTES)
        deal = F.pmod(F.xxhash64(*[named(c) for c in ids]), F.lit(passes))
        data = index.data.where(F.col("cell").isin(wanted))
        parts = [_cells_pass(data, cells, asked.where(deal == p).toArrow(), keys, k, vector, query_vector, chunk, cut, floor, schema) for p in range(passes)]
        ranked = functools.reduce(DataFrame.unionByName, parts).withColumn(rank, F.row_number().over(best))
        return stored(ranked.where(F.col(rank) <= k).drop(rank), "index-found")

    none = F.lit(None).cast("double")
    steps = list(growth[-1:]) if sure else list(growth)
    probes = stored(_probes(questions, index, query_vector, max(steps, default=0)), "index-probes")
    found, left = None, questions
    for step in steps:
        asked_cells = probes.where(F.col("ahead") < step)
        cuts = asked_cells.groupBy(*[named(c) for c in ids]).agg(F.min("near").alias(cut))
        asked = stored(left.join(cuts, list(ids)).withColumn(floor, none), "index-asked")
        got = searched(asked, [r[0] for r in asked_cells.join(asked.select(*ids), list(ids), "left_semi").select("cell").distinct().collect()])
        if got is not None:
            found = got if found is None else found.join(left.select(*ids), list(ids), "left_anti").unionByName(got)
        if sure or step == steps[-1]:
            break
        if found is not None:
            done = found.groupBy(*ids).agg(F.count("*").alias("hits")).where(F.col("hits") >= k)
            left = stored(questions.join(done, list(ids), "left_anti"), "index-open")
            if left.isEmpty():
                break
    if sure:
        asked = questions.withColumn(floor, none)
        if found is not None:
            kth = found.groupBy(*ids).agg(F.when(F.count("*") >= k, F.min("score") - 10.0**-DIGITS).alias(floor))
            asked = questions.join(kth, list(ids), "left")
        asked = stored(asked.withColumn(cut, none), "index-asked")
        found = searched(asked, _reached(asked, cells, query_vector, floor))
    if found is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    return found.withColumn("rank", F.row_number().over(best))
