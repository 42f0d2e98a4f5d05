"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

A token's score is the lower bound of its toxic/clean log-odds under a Dirichlet prior, or a small negative drift.
One linear scan finds every maximal segment of a text. Under the clean token distribution the best segment of n
tokens exceeds S with probability about 1 - exp(-K n exp(-lambda S)); lambda is the root over the scores of the clean
training tokens, K is fitted to the best segments of the clean training texts. Passages below a p-value are
significant, and a logistic curve over their normalised scores gives the document's probability. All three are
measured on texts by weights learned from the other half of the sample, as unseen texts will be.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, sampled, small_batches, stored, table

#: Bound of the training sample: about so many documents of each label. Whole texts of the sample are used.
PER_LABEL = 8000
#: Weight of the Dirichlet prior in documents, and the one-sided bound in standard deviations.
PRIOR, BOUND = 20.0, 2.33
DRIFT, SIGNIFICANT = 0.1, 0.05
TOKEN = re.compile(r"[^\W_]+")
STEMS = (3, 4, 5, 6)
COUNTED = ("clean0", "toxic0", "clean1", "toxic1")


def features(token: str) -> Iterator[str]:
    """A token and its longer-than-stem beginnings, so that unseen compounds share what is known of their start."""
    yield token
    for k in STEMS:
        if len(token) > k:
            yield f"^{token[:k]}"


def segments(scores: Sequence[tuple[int, float]], n: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in order; scores lists the positive tokens by position.

    Every other of the n tokens scores -drift. Linear time: each candidate is merged with earlier ones at most once.
    """
    out: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest lower start
    total, at = 0.0, 0
    for i, s in scores:
        total -= drift * (i - at)
        before, start, total, at = total, i, total + s, i + 1
        k = len(out) - 1
        while True:
            while k >= 0 and out[k][2] >= before:
                k = out[k][4]
            if k < 0 or out[k][3] >= total:
                break
            start, before = out[k][0], out[k][2]  # joins that segment and all after it
            del out[k:]
            k -= 1
        out.append((start, i + 1, before, total, k))
    return [(a, b, after - before) for a, b, before, after, _ in out]


@dataclass
class ToxicModel:
    weights: dict[str, float]
    rate: float = 1.0
    space: float = 1.0
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, token: str) -> float:
        """The largest log-odds bound among the token's features; 0 if none is positive."""
        got = self.seen.get(token)
        if got is None:
            got = max((self.weights.get(f, 0.0) for f in features(token)), default=0.0)
            if len(token) < 64:
                if len(self.seen) >= 300_000:
                    self.seen.clear()
                self.seen[token] = got
        return got

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """Number of tokens, and the positive ones as (position, score)."""
        tokens = TOKEN.findall((text or "").lower())
        score = self.score
        return len(tokens), [(i, s) for i, t in enumerate(tokens) if (s := score(t)) > 0]

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the significant passages as (first token, end, normalised score)."""
        tokens, hits = self.hits(text)
        if not hits:
            return tokens, []
        level = math.log(self.space * tokens)
        found = [(a, b, self.rate * s - level) for a, b, s in segments(hits, tokens, DRIFT)]
        return tokens, [x for x in found if -math.expm1(-math.exp(-max(x[2], -30.0))) <= SIGNIFICANT]

    def statistics(self, text: str | None) -> tuple[float, float, list[tuple[int, int, float]]]:
        found = self.passages(text)[1]
        values = [x for _, _, x in found]
        return math.log1p(max(values, default=0.0)), math.log1p(sum(values)), found

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, a + b * best + c * total))))


def decay(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive root lambda of sum p exp(lambda s) = 1 where tokens score s with these shares, all others -drift."""
    rest = max(1e-9, 1 - shares.sum())

    def over(x: float) -> bool:
        return float((shares * np.exp(np.minimum(x * scores, 700))).sum()) + rest * math.exp(-x * drift) > 1

    low, high = 1e-6, 1.0
    while not over(high) and high < 1e3:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return low


def bounds(clean: np.ndarray, toxic: np.ndarray, n_clean: float, n_toxic: float) -> np.ndarray:
    """Lower bounds of the log-odds of tokens in so many of the clean and toxic documents, under a Dirichlet prior."""
    alpha = PRIOR * (toxic + clean) / max(1e-9, n_toxic + n_clean) + 1e-12
    odds = np.log((toxic + alpha) / (n_toxic + PRIOR)) - np.log((clean + alpha) / (n_clean + PRIOR))
    return odds - BOUND * np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method with a small ridge: intercept and two slopes."""
    z, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9)
        beta = beta + np.linalg.solve((z * w[:, None]).T @ z + ridge * np.eye(3), z.T @ (y - p) - ridge * beta)
    return tuple(map(float, beta))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> ToxicModel:
    """Learns from a bounded, hash-chosen sample of the labelled rows that have a document.

    Null labels are left out; repeated ids count once with their largest label. The sample of label rows is bounded,
    so it is broadcast to the documents; whole texts of the sample are kept for the second pass. Sampled texts of one
    label with the same words in the same order are copies: together they count as one document, every other fully.
    """
    small_batches(docs.sparkSession)
    rows = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(label).cast("int").alias("_label"))
    chosen = sampled(rows, "_label", per_label, "toxicity", id_column)
    copy = F.sha2(F.array_join(F.split(F.lower(text), r"[\s\p{Punct}]+"), " "), 256)
    drawn = stored(docs.select(id_column, text).join(F.broadcast(chosen), id_column).select(F.col(text).alias("text"), "_label", copy.alias("copy")), "toxic-sample")
    sizes = drawn.groupBy(F.col("_label").alias("_of"), F.col("copy").alias("_copy")).agg((1.0 / F.count("*")).alias("weight"))
    half = F.pmod(F.xxhash64("copy"), F.lit(2)).cast("int").alias("half")  # copies are in one half
    texts = stored(drawn.join(sizes, (F.col("_label") == F.col("_of")) & F.col("copy").eqNullSafe(F.col("_copy"))).select("text", "_label", "weight", half), "toxic-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [defaultdict(float) for _ in range(4)]  # clean and toxic of either half
        for b in batches:
            for t, y, w, h in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = seen[2 * h + (y > 0)]
                own[""] += w
                for f in {f for token in set(TOKEN.findall((t or "").lower())) for f in features(token)}:
                    own[f] += w
        keys = list(set().union(*seen))
        columns = [pa.array(keys, pa.string()), *[pa.array([part.get(k, 0.0) for k in keys], pa.float64()) for part in seen]]
        yield pa.RecordBatch.from_arrays(columns, names=["token", *COUNTED])

    counts = texts.mapInArrow(count, "token string, " + ", ".join(f"{c} double" for c in COUNTED)).groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTED])
    # A token of one toxic document has no positive bound; what is left is bounded by the sample's texts.
    rows_of = stored(counts, "toxic-counts").where("token = '' OR toxic0 + toxic1 > 1.01").collect()
    table_of = np.array([[r[c] for c in COUNTED] for r in rows_of if r["token"]], float).reshape(-1, 4)
    tokens = [r["token"] for r in rows_of if r["token"]]
    totals = np.array([[r[c] for c in COUNTED] for r in rows_of if not r["token"]] or [[0.0] * 4], float)[0]

    def learned(halves: Sequence[int]) -> ToxicModel:
        clean, toxic = sum(table_of[:, 2 * h] for h in halves), sum(table_of[:, 2 * h + 1] for h in halves)
        bound = bounds(clean, toxic, sum(totals[2 * h] for h in halves), sum(totals[2 * h + 1] for h in halves))
        return ToxicModel({tokens[k]: float(bound[k]) for k in np.flatnonzero(bound > 0)})

    model, others = learned([0, 1]), [learned([1]), learned([0])]  # by half: what the other half teaches
    if not model.weights or not totals[[0, 2]].sum():
        return ToxicModel({})

    def clean_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[float, float] = defaultdict(float)
        for b in batches:
            for t, _, w, h in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n, hits = others[h].hits(t)
                seen[0.0] += w * (n - len(hits))
                for _, s in hits:
                    seen[round(s, 2)] += w
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.float64())], names=["score", "n"])

    clean_texts = texts.where("_label = 0")
    met = clean_texts.mapInArrow(clean_scores, "score double, n double").groupBy("score").agg(F.sum("n")).collect()
    scores, times = np.array([r[0] for r in met]), np.array([r[1] for r in met])
    model.rate = decay(scores[scores > 0], times[scores > 0] / max(1.0, times.sum()), DRIFT) if (scores > 0).any() else 1.0
    for m in others:
        m.rate = model.rate

    def clean_maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of weight and of weight n exp(-lambda S): under the law, each n K exp(-lambda S) is exponential with mean one."""
        texts_seen = mass = 0.0
        for b in batches:
            for t, _, w, h in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n, hits = others[h].hits(t)
                if n:
                    best = max((s for _, _, s in segments(hits, n, DRIFT)), default=0.0)
                    texts_seen, mass = texts_seen + w, mass + w * n * math.exp(-model.rate * best)
        yield pa.RecordBatch.from_arrays([pa.array([texts_seen]), pa.array([mass])], names=["texts", "mass"])

    n_texts, mass = clean_texts.mapInArrow(clean_maxima, "texts double, mass double").agg(F.sum("texts"), F.sum("mass")).first()
    model.space = n_texts / mass if mass else 1.0
    for m in others:
        m.space = model.space

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [others[h].statistics(t)[:2] for t, h in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.float64()), pa.array([x for _, x in got], pa.float64()), b.column(1)], names=["best", "total", "label"])

    measured = sorted(map(tuple, texts.mapInArrow(measure, "best double, total double, label int").collect()))
    x = np.array([m[:2] for m in measured])
    model.curve = logistic(x, np.array([float(m[2] > 0) for m in measured]))
    model.seen.clear()
    return model


def score(docs: DataFrame, model: ToxicModel, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted, n_passages, passages): one row for each row of docs.

    passages: (start, end, score) in tokens. Null and empty texts have no passage and the score of none.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list[Any]] = {"score": [], "predicted": [], "n_passages": [], "passages": []}
            for t in b.column(1).to_pylist():
                best, total, found = model.statistics(t)
                p = model.probability(best, total)
                out["score"].append(p), out["predicted"].append(int(p >= 0.5)), out["n_passages"].append(len(found))
                out["passages"].append([{"start": a, "end": z, "score": s} for a, z, s in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out["score"], pa.float64()), pa.array(out["predicted"], pa.int32()), pa.array(out["n_passages"], pa.int32()), pa.array(out["passages"], spans)], names=["id", *out])

    schema = f"id {kind}, score double, predicted int, n_passages int, passages array<struct<start:int,end:int,score:double>>"
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_passages", "passages")
