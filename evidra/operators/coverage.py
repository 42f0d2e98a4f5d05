"""Coverage of request and year cells, and packing of contexts under a budget."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks and characters of a context, and fallback chunks of an empty cell.
MOST_CHUNKS, MOST_CHARS, FALLBACKS = 24, 70_000, 1


def cells(requests: DataFrame, keys: Sequence[str], first: Column, last: Column) -> DataFrame:
    """(keys..., year): every requested year."""
    return requests.select(*keys, F.explode(F.sequence(first, last)).alias("year"))


def missing_cells(asked: DataFrame, covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    return asked.join(covered.select(*keys, "year").distinct(), [*keys, "year"], "left_anti")


def coverage_summary(asked: DataFrame, covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., expected, covered, missing): counts of cells, and the missing years in order."""
    marked = asked.join(covered.select(*keys, "year").distinct().withColumn("_hit", F.lit(True)), [*keys, "year"], "left")
    gone = F.array_sort(F.collect_set(F.when(F.col("_hit").isNull(), F.col("year"))))
    return marked.groupBy(*keys).agg(F.count("*").alias("expected"), F.count("_hit").alias("covered"), gone.alias("missing"))


def status(documents: Column, qualified: Column, selected: Column, expected: Column, covered: Column) -> Column:
    """The first that applies of no_document, insufficient_relevance, no_chunk_selected, partial, covered."""
    return F.when(documents == 0, "no_document").when(qualified == 0, "insufficient_relevance").when(selected == 0, "no_chunk_selected").when(covered < expected, "partial").otherwise("covered")


def _pack_one(rows: pd.DataFrame, most_chunks: int, most_chars: int) -> list[dict[str, Any]]:
    """One question: rows of (cell_order, request_id, year, chunk_id, chars, query_score, final_score, qualified)."""
    pools: dict[tuple[Any, Any], list[Any]] = {}
    loose: dict[tuple[Any, Any], list[Any]] = {}
    order = rows.sort_values(["cell_order", "final_score", "chunk_id"], ascending=[True, False, True], kind="stable")
    for r in order.itertuples():
        cell = (r.request_id, r.year)
        pools.setdefault(cell, [])
        loose.setdefault(cell, []).append(r)
        if r.qualified:
            pools[cell].append(r)
    for cell, held in loose.items():
        loose[cell] = sorted(held, key=lambda r: (-r.query_score, -r.final_score, r.chunk_id))
    sizes: dict[Any, int] = {}
    taken: dict[tuple[Any, Any], list[tuple[Any, int, bool]]] = {c: [] for c in pools}
    step = 0

    def take(cell: tuple[Any, Any], r: Any, fallback: bool) -> bool:
        nonlocal step
        if any(x.chunk_id == r.chunk_id for x, _, _ in taken[cell]):
            return False
        if r.chunk_id not in sizes and (len(sizes) >= most_chunks or sum(sizes.values()) + r.chars > most_chars):
            return False
        sizes.setdefault(r.chunk_id, r.chars)
        step += 1
        taken[cell].append((r, step, fallback))
        return True

    for cell, pool in pools.items():
        any(take(cell, r, False) for r in pool)
    for cell in pools:
        if not taken[cell]:
            given = 0
            for r in loose[cell]:
                given += given < FALLBACKS and take(cell, r, True)
    per_cell = max(2, most_chunks // max(1, len(pools)))
    for level in range(1, per_cell):
        while len(sizes) < most_chunks:
            ready = [c for c in pools if len(taken[c]) == level and not taken[c][0][2]]
            heads = []
            for c in ready:
                left = [r for r in pools[c] if not any(r.chunk_id == x.chunk_id for x, _, _ in taken[c])]
                if left:
                    heads.append((-left[0].final_score, left[0].chunk_id, c, left))
            if not any(take(c, r, False) for _, _, c, left in sorted(heads, key=lambda h: h[:2]) for r in left):
                break
    return [{"request_id": c[0], "year": c[1], "chunk_id": r.chunk_id, "step": n, "fallback": f} for c, held in taken.items() for r, n, f in held]


def pack(candidates: DataFrame, most_chunks: int = MOST_CHUNKS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(question_id, request_id, year, chunk_id, step, fallback): the context of each question under its budget.

    First the best qualified chunk of every cell, then one unqualified for cells still empty, then rounds over cells by
    the score of what they offer next. A chunk in several cells costs once; one that overflows is passed over. The
    greedy choice is sequential, so each question is one task over all its candidates.
    """
    kinds = dict(candidates.dtypes)
    schema = f"question_id {kinds['question_id']}, request_id {kinds['request_id']}, year {kinds['year']}, chunk_id {kinds['chunk_id']}, step int, fallback boolean"

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        got = pd.DataFrame(_pack_one(rows, most_chunks, most_chars), columns=["request_id", "year", "chunk_id", "step", "fallback"])
        got.insert(0, "question_id", key[0])
        return got

    columns = ["question_id", "request_id", "year", "chunk_id", "chars", "query_score", "final_score", "qualified", "cell_order"]
    return candidates.select(*columns).groupBy("question_id").applyInPandas(run, schema)
