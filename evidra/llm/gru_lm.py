"""Gated recurrent language model with class-factored outputs, trained here by truncated backpropagation in numpy.

Words of the model's own vocabulary are in classes by frequency; every other word falls into an ending class by its
last two bytes. A token's probability is that of its class given the state, times that of the word in its class: a
softmax for vocabulary words, and smoothed corpus counts for the others. The state runs from the first to the last
token of a text. Counts cover every training document. The network starts from a bounded sample; then every task
carries it on over every token of its training documents, and the tasks' weights are averaged by tokens, so that it
learns from the whole corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_least, draw, one_blas_thread, remainder, scratch, small_batches, stored

#: Vocabulary words (the end of a text is number 0), words of a class, ending classes, state size.
VOCABULARY, IN_CLASS, ENDINGS, STATE = 2048, 64, 96, 32
#: Words whose counts every task holds; the others are counted by a join.
HEAD = 1 << 16
#: Bound of the sample that the network starts from, in documents and in tokens of each; lanes and steps of a window.
SAMPLE, SAMPLE_TOKENS, LANES, STEPS = 3000, 400, 64, 24
#: Lanes in the pass over every training token, and tokens of a lane learned from at once; parts that a set of weights
#: is cut into when it is averaged.
WIDE, LANE, PARTS = 256, 480, 64
#: Words counted before they are passed on; tokens scored together; bytes of texts read together.
COUNTED, TOGETHER, READ_BYTES = 4_000_000, 1_500_000, 4 << 20
#: Rows that go through the output layer together, numbers of one update, states collected before they are scored: what
#: a core's cache holds.
ROWS_TOGETHER, STRETCH, SCORED = 512, 1 << 15, 1 << 13
#: Texts that are scored step by step together.
GROUP = 512
#: Repeats of an input whose gradients are summed for all inputs at once.
ROUNDS = 24
ADD = 0.1


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; exp may run over to infinity, whose inverse is 0 as it should be."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += np.float32(1)
    np.reciprocal(x, out=x)
    return x


class _Laid:
    """Weights (or their gradients) in one run of numbers: x and u as planes of update, reset and candidate gate, c and
    w (by class) with their biases as a last row, which meets a last column of ones."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None) -> None:
        heads, s = VOCABULARY // IN_CLASS, STATE
        shapes = [(3, VOCABULARY + ENDINGS, s), (3, s, s), (s + 1, heads + ENDINGS), (heads, s + 1, IN_CLASS)]
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        self.flat = np.zeros(ends[-1], np.float32)
        self.x, self.u, self.c, self.w = (part.reshape(shape) for part, shape in zip(np.split(self.flat, ends[:-1]), shapes, strict=True))
        if weights:
            self.x[:] = weights["x"].reshape(-1, 3, s).transpose(1, 0, 2)
            self.u[:] = weights["u"].reshape(s, 3, s).transpose(1, 0, 2)
            self.c[:s], self.c[s] = weights["c"], weights["cb"]
            self.w[:, :s], self.w[:, s] = weights["w"].reshape(s, heads, IN_CLASS).transpose(1, 0, 2), weights["wb"].reshape(heads, IN_CLASS)

    def weights(self) -> dict[str, np.ndarray]:
        s = STATE
        return {
            "x": self.x.transpose(1, 0, 2).reshape(-1, 3 * s), "u": self.u.transpose(1, 0, 2).reshape(s, 3 * s),
            "c": self.c[:s].copy(), "cb": self.c[s].copy(),
            "w": self.w[:, :s].transpose(1, 0, 2).reshape(s, VOCABULARY), "wb": self.w[:, s].reshape(VOCABULARY),
        }

    def bounded(self) -> bool:
        """Whether no logit can be large: states are within -1 and 1, so sums of absolute weights bound them."""
        return bool(np.abs(self.c).sum(axis=0).max() < 60 and np.abs(self.w).sum(axis=1).max() < 60)

    def step(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, out: np.ndarray) -> None:
        """The state after h into out. x holds the inputs' planes and then the gates; own gets what the candidate takes
        from h before the reset; y is room for two planes."""
        np.matmul(h, self.u[:2], out=y)
        x[:2] += y
        z, r = _sigmoid(x[:2])
        np.matmul(h, self.u[2], out=own)
        n = x[2]
        n += np.multiply(r, own, out=y[0])
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= z
        out += n


def _exp(x: np.ndarray, bounded: bool) -> np.ndarray | float:
    """exp of x in place, each row less its largest number unless all are bounded; returns what was taken off."""
    top: np.ndarray | float = 0.0
    if not bounded:
        top = x.max(axis=1)
        x -= top[:, None]
    np.exp(x, out=x)
    return top


def _classes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Class of each number, the places of vocabulary words sorted by class, and where each class begins there."""
    heads = VOCABULARY // IN_CLASS
    cls = np.where(ids < VOCABULARY, ids // IN_CLASS, ids - VOCABULARY + heads).astype(np.uint16)
    order = np.argsort(cls, kind="stable")
    edges = np.searchsorted(cls[order], np.arange(heads + 1)).tolist()
    return cls, order[: edges[-1]], edges


def _add_by(ids: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Adds the rows of all planes to the rows of out that ids name: the first of each id at once, then the second of
    each, up to ROUNDS; what is left of frequent ids, an id at a time."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    met, starts, times = np.unique(ids[order], return_index=True, return_counts=True)
    often = np.argsort(-times, kind="stable")
    met, starts, times = met[often], starts[often], times[often]
    rows, ones = rows.take(order, axis=1), np.ones(int(times[0]), np.float32)
    sums = rows.take(starts, axis=1)
    for k in range(1, min(ROUNDS, int(times[0]))):
        more = int(np.searchsorted(-times, -k))
        sums[:, :more] += rows.take(starts[:more] + k, axis=1)
    for k in range(int(np.searchsorted(-times, -ROUNDS))):
        left = rows[:, starts[k] + ROUNDS : starts[k] + times[k]]
        sums[:, k] += ones[: left.shape[1]] @ left
    for plane in range(len(out)):
        out[plane, met] += sums[plane]


@dataclass
class Gru:
    """Inputs and outputs are numbers below VOCABULARY + ENDINGS; classes: vocabulary classes, then ending classes."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 5) -> Gru:
        rng, heads = np.random.default_rng(seed), VOCABULARY // IN_CLASS
        make = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
        return cls({
            "x": (0.3 * rng.normal(0, 1, (VOCABULARY + ENDINGS, 3 * STATE))).astype(np.float32), "u": make(STATE, 3 * STATE),
            "c": make(STATE, heads + ENDINGS), "cb": np.zeros(heads + ENDINGS, np.float32),
            "w": make(STATE, VOCABULARY), "wb": np.zeros(VOCABULARY, np.float32),
        })

    def step(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        laid, out = _Laid(self.weights), np.empty_like(h)
        x, y, own = laid.x[:, ids], np.empty((2, *h.shape), np.float32), np.empty_like(h)
        laid.step(h, x, y, own, out)
        return out, (h, *x, own)

    def log_probability(self, h: np.ndarray, ids: np.ndarray, laid: _Laid | None = None, bounded: bool = False) -> np.ndarray:
        """Natural log of class and, for vocabulary words, of the word in its class. h may end with a column of ones."""
        laid = laid or _Laid(self.weights)
        hs = h if h.shape[1] > STATE else np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)
        cls, order, edges = _classes(ids)
        out = np.empty(len(ids), np.float32)

        def logs(rows: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            part = rows @ weights
            got = part[np.arange(len(part)), wanted]
            top = _exp(part, bounded)
            return got - top - np.log(part @ np.ones(part.shape[1], np.float32))

        for at in range(0, len(ids), ROWS_TOGETHER):
            rows = slice(at, at + ROWS_TOGETHER)
            out[rows] = logs(hs[rows], laid.c, cls[rows])
        own, inside, gained = hs[order], ids[order] % IN_CLASS, np.empty(len(order), np.float32)
        for c, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            for at in range(low, high, 2 * ROWS_TOGETHER):
                rows = slice(at, min(high, at + 2 * ROWS_TOGETHER))
                gained[rows] = logs(own[rows], laid.w[c], inside[rows])
        out[order] += gained
        return out

    def learn(self, streams: np.ndarray, epochs: int = 2, rate: float = 4e-3) -> None:
        """Adam over windows of STEPS tokens; the state is carried from window to window and cut at text ends."""
        one_blas_thread()
        s, lanes = STATE, len(streams)
        laid, g = _Laid(self.weights), _Laid()
        first, second, t = np.zeros_like(laid.flat), np.zeros_like(laid.flat), 0
        full = STEPS * lanes
        x_of, own_of, before_of = np.empty((3, full, s), np.float32), np.empty((full, s), np.float32), np.empty((full, s), np.float32)
        hs_of, gh_of, y, (a, b) = np.ones((full, s + 1), np.float32), np.empty((full, s), np.float32), np.empty((2, lanes, s), np.float32), np.empty((2, lanes, s), np.float32)
        one, turned = np.float32(1), laid.u.transpose(0, 2, 1)
        for _ in range(epochs):
            h = np.zeros((lanes, s), np.float32)
            for at in range(0, streams.shape[1] - 1, STEPS):
                block = streams[:, at : at + STEPS + 1].T.astype(np.intp)
                steps = len(block) - 1
                size = steps * lanes
                read, ids, goes_on = block[:-1].ravel(), block[1:].ravel(), (block[:-1] != 0).astype(np.float32)[:, :, None]
                x, own, before, hs, gh = x_of[:, :size], own_of[:size], before_of[:size], hs_of[:size], gh_of[:size]
                for k in range(steps):
                    rows = slice(k * lanes, (k + 1) * lanes)
                    for plane in range(3):
                        np.take(laid.x[plane], block[k], axis=0, out=x[plane, rows], mode="clip")
                    np.multiply(h, goes_on[k], out=before[rows])
                    laid.step(before[rows], x[:, rows], y, own[rows], h)
                    hs[rows, :s] = h
                self._outputs(laid, g, hs, ids, gh)
                back = np.zeros_like(h)
                for k in range(steps - 1, -1, -1):  # the gradients of the three planes take the gates' place
                    rows = slice(k * lanes, (k + 1) * lanes)
                    (z, r, n), yn, d = x[:, rows], own[rows], gh[rows]
                    d += back
                    np.multiply(d, z, out=back)
                    np.subtract(before[rows], n, out=a)
                    np.subtract(one, z, out=b)
                    n *= n
                    np.subtract(one, n, out=n)
                    n *= d
                    n *= b
                    b *= z
                    b *= a
                    np.multiply(b, d, out=z)
                    np.subtract(one, r, out=a)
                    a *= r
                    a *= yn
                    np.multiply(n, r, out=yn)
                    np.multiply(a, n, out=r)
                    back += np.matmul(yn, turned[2], out=a)
                    np.matmul(x[:2, rows], turned[:2], out=y)
                    back += y[0]
                    back += y[1]
                    back *= goes_on[k]
                np.matmul(before.T, x[:2], out=g.u[:2])
                np.matmul(before.T, own, out=g.u[2])
                g.x[:] = 0
                _add_by(read, x, g.x)
                t += 1
                self._adam(laid.flat, g.flat, first, second, t, rate)
        self.weights.update(laid.weights())

    @staticmethod
    def _outputs(laid: _Laid, g: _Laid, hs: np.ndarray, ids: np.ndarray, gh: np.ndarray) -> None:
        """Gradients of the output weights into g and of the states into gh, of the mean loss over all rows of hs."""
        scale, bounded, (cls, order, edges) = np.float32(1 / len(ids)), laid.bounded(), _classes(ids)

        def part_of(rows: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            p = rows @ weights
            _exp(p, bounded)
            p *= (scale / (p @ np.ones(p.shape[1], np.float32)))[:, None]
            p[np.arange(len(p)), wanted] -= scale
            return p

        g.c[:], g.w[:] = 0, 0
        states = laid.c[:STATE].T
        for at in range(0, len(ids), ROWS_TOGETHER):
            rows = slice(at, at + ROWS_TOGETHER)
            p = part_of(hs[rows], laid.c, cls[rows])
            g.c += hs[rows].T @ p
            np.matmul(p, states, out=gh[rows])
        own, inside, gained = hs.take(order, axis=0), ids[order] % IN_CLASS, np.empty((len(order), STATE), np.float32)
        for c, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            for at in range(low, high, 2 * ROWS_TOGETHER):
                rows = slice(at, min(high, at + 2 * ROWS_TOGETHER))
                p = part_of(own[rows], laid.w[c], inside[rows])
                g.w[c] += own[rows].T @ p
                np.matmul(p, laid.w[c, :STATE].T, out=gained[rows])
        gh[order] += gained

    @staticmethod
    def _adam(w: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, t: int, rate: float) -> None:
        """Update t of w, a stretch at a time, so that a stretch stays in the cache through all operations.

        The moments are held without their factors of 0.1 and 0.01, which the rate and the root take in.
        """
        root = np.sqrt(0.01 / (1 - 0.99**t))
        rate, least, clipped = np.float32(rate * 0.1 / (1 - 0.9**t) / root), np.float32(1e-8 / root), not np.dot(g, g) <= 1
        spare_of = np.empty(min(len(w), STRETCH), np.float32)
        for at in range(0, len(w), STRETCH):
            part = slice(at, at + STRETCH)
            gk, m, v = g[part], first[part], second[part]
            spare = spare_of[: len(gk)]
            if clipped:
                np.clip(gk, -1, 1, out=gk)
            m *= np.float32(0.9)
            m += gk
            gk *= gk
            v *= np.float32(0.99)
            v += gk
            np.sqrt(v, out=spare)
            spare += least
            np.divide(m, spare, out=spare)
            spare *= rate
            w[part] -= spare

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log of each whole text (numbers, ending with 0): GROUP texts of like lengths at a time, the longest
        first, one step of all of them at a time."""
        one_blas_thread()
        laid, s, out = _Laid(self.weights), STATE, np.zeros(len(texts))
        bounded, by_length = laid.bounded(), sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        x_of, y_of, own_of = (np.empty((n, GROUP, s), np.float32) for n in (3, 2, 1))
        hs = np.ones((SCORED + GROUP, s + 1), np.float32)
        for first in range(0, len(texts), GROUP):
            order = by_length[first : first + GROUP]
            lengths = np.array([len(texts[k]) for k in order])
            flat, starts = np.concatenate([texts[k] for k in order]).astype(np.intp), np.cumsum(lengths) - lengths
            longest = int(lengths[0])
            alive = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()
            total, h, before = np.zeros(len(order)), np.zeros((len(order), s), np.float32), np.zeros(len(order), np.intp)
            held: list[np.ndarray] = []
            count = 0
            for t in range(longest):
                active = alive[t]
                x, now = x_of[:, :active], flat[starts[:active] + t]
                for plane in range(3):
                    np.take(laid.x[plane], before[:active], axis=0, out=x[plane], mode="clip")
                laid.step(h[:active], x, y_of[:, :active], own_of[0, :active], h[:active])
                hs[count : count + active, :s] = h[:active]
                held.append(now)
                before = now
                count += active
                if count >= SCORED or t == longest - 1:
                    got = self.log_probability(hs[:count], np.concatenate(held), laid, bounded)
                    where = 0
                    for ids in held:
                        total[: len(ids)] += got[where : where + len(ids)]
                        where += len(ids)
                    held, count = [], 0
            out[order] = total
        return out


@dataclass
class Counts:
    """head: count of each of the commonest words, in order; masses: smoothed mass of each ending class outside the vocabulary."""

    head: dict[bytes, int]
    counts: np.ndarray
    numbers: np.ndarray
    masses: np.ndarray
    tokens: int
    distinct: int
    ends: int


def cut_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of each text as common.words() cuts them: how many each text has, and all of them in order (null: none)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    amounts, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().cast(pa.binary())
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return amounts, flat
    owners = np.repeat(np.arange(len(amounts)), amounts)  # a blank text is cut into one empty word
    return np.bincount(owners[full], minlength=len(amounts)), flat.filter(pa.array(full))


def by_size(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about READ_BYTES of text, a text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.unique((ends // READ_BYTES), return_index=True)[1].tolist()
    for low, high in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(low, high - low)


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over every whole text, summed within each task before the shuffle; the empty word stands for ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        texts = 0

        def flushed() -> pa.RecordBatch:
            nonlocal texts
            seen = pc.value_counts(pa.chunked_array([*held, pa.array([b""], pa.binary())]))
            times = seen.field(1).to_numpy().copy()
            times[-1] = texts  # the empty word is last, since no text holds it
            held.clear()
            texts = 0
            return pa.RecordBatch.from_arrays([seen.field(0), pa.array(times, pa.int64())], names=["word", "c"])

        for b in batches:
            for part in by_size(b, 0):
                held.append(cut_words(part.column(0))[1])
                texts += part.num_rows
                if sum(map(len, held)) > COUNTED:
                    yield flushed()
        yield flushed()

    return train.select(text).mapInArrow(run, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def summarise(vocabulary: DataFrame) -> Counts:
    """The bounded part of the counts that every task needs, and sums by ending class."""
    tokens, distinct = vocabulary.agg(F.sum("c"), F.count("*")).first()
    top = sorted(at_least(vocabulary.where("word <> X''"), "c", HEAD).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    ends = (vocabulary.where("word = X''").first() or {"c": 0})["c"]
    listed = [(bytes(r["word"]), r["c"]) for r in top]
    by_class = vocabulary.where("word <> X''").groupBy((F.crc32(F.substring("word", -2, 2)) % ENDINGS).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    masses = np.full(ENDINGS, ADD)
    for r in by_class:
        masses[r["k"]] += r["c"] + ADD * r["n"]
    for w, c in listed[: VOCABULARY - 1]:
        masses[ending(w)] -= c + ADD
    numbers = np.array([k + 1 if k < VOCABULARY - 1 else VOCABULARY + ending(w) for k, (w, _) in enumerate(listed)], np.int32)
    return Counts({w: k for k, (w, _) in enumerate(listed)}, np.array([c for _, c in listed], np.int64), numbers, np.maximum(masses, ADD), tokens or 0, distinct or 0, ends)


@dataclass
class Texts:
    """Several texts as read: numbers of all in order, each text's end included, and where each text stops; words
    outside the head and their texts; for each text the base log10 sum, that of words in ending classes, tokens in the head."""

    numbers: np.ndarray
    stops: np.ndarray
    outside: pa.Array
    owners: np.ndarray
    base: np.ndarray
    classed: np.ndarray
    known: np.ndarray


class Reader:
    """Turns texts into numbers and their counted parts."""

    def __init__(self, counts: Counts) -> None:
        self.counts, self.head = counts, pa.array(list(counts.head), pa.binary())
        self.log_count = np.log10(counts.counts + ADD)
        self.less_mass = -np.log10(counts.masses)
        self.in_class = np.zeros(len(counts.numbers))
        classed = counts.numbers >= VOCABULARY
        self.in_class[classed] = self.log_count[classed] + self.less_mass[counts.numbers[classed] - VOCABULARY]
        self.ending_of = np.array([ending(bytes(divmod(k, 256))) for k in range(1 << 16)] + [ending(bytes([k])) for k in range(256)], np.int64)

    def endings(self, found: pa.Array) -> np.ndarray:
        """ending() of each word, by its last two bytes or its only one."""
        if not len(found):
            return np.zeros(0, np.int64)
        raw, ends = np.frombuffer(found.buffers()[2], np.uint8), np.frombuffer(found.buffers()[1], np.int32)[found.offset :][: len(found) + 1]
        last = raw[ends[1:] - 1].astype(np.int64)
        return self.ending_of[np.where(np.diff(ends) > 1, 256 * raw[np.maximum(ends[1:] - 2, 0)].astype(np.int64) + last, (1 << 16) + last)]

    def read(self, texts: pa.Array) -> Texts:
        c = self.counts
        amounts, flat = cut_words(texts)
        stops = np.cumsum(amounts + 1)
        starts, size = stops - amounts - 1, int(stops[-1])
        place = np.delete(np.arange(size), stops - 1)
        at = pc.fill_null(pc.index_in(flat, value_set=self.head), -1).to_numpy()
        inside = at >= 0
        outside, rare, at, common = flat.filter(pa.array(~inside)), place[~inside], at[inside], place[inside]
        numbers, logs, classed, met = np.zeros(size, np.uint16), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        endings = self.endings(outside)
        numbers[rare], classed[rare] = VOCABULARY + endings, self.less_mass[endings]
        numbers[common], logs[common], classed[common], met[common] = c.numbers[at], self.log_count[at], self.in_class[at], 1
        logs, classed, met = (np.add.reduceat(x, starts) for x in (logs, classed, met))
        return Texts(numbers, stops, outside, np.searchsorted(stops, rare, side="right"), logs + np.log10(c.ends + ADD), classed, met + (c.ends > 0))


READ = "kind string, rid long, doc_id long, train boolean, n_tokens long, known long, base double, classed double, numbers binary, word binary, n long"


def read(docs: DataFrame, counts: Counts, train: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of kind doc with the numbers of each text (two bytes each), which learning and scoring take instead of the
    text, and of kind word with the words outside the head and their times; null texts are their end alone.

    A row's number is fixed by writing the rows before they are used. Texts are read in this scan only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(counts)
    fields = [f.split() for f in READ.split(", ")]
    names = [f[0] for f in fields]
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}[f[1]] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, serial = Reader(shared.value), TaskContext.get().partitionId() << 36
        for b in batches:
            for part in by_size(b, 2):
                got, size = reader.read(part.column(2)), part.num_rows
                rids, lengths = np.arange(serial + 1, serial + 1 + size), np.diff(got.stops, prepend=0)
                offsets = pa.py_buffer((2 * np.concatenate([[0], got.stops])).astype(np.int32))
                numbers = pa.Array.from_buffers(pa.binary(), size, [None, offsets, pa.py_buffer(got.numbers.astype("<u2"))])
                columns = [["doc"] * size, rids, part.column(0), part.column(1), lengths, got.known, got.base, got.classed, numbers]
                full = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*full, *[pa.nulls(size, k) for k in kinds[9:]]], names=names)
                found = pa.table({"rid": rids[got.owners], "word": got.outside}).group_by(["rid", "word"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                rid, word, times = (found[k].combine_chunks() if len(found) else pa.array([], t) for k, t in (("rid", pa.int64()), ("word", pa.binary()), ("count_all", pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(["word"] * len(rid), pa.string()), rid, *[pa.nulls(len(rid), k) for k in kinds[2:9]], word, times], names=names)
                serial += size

    path = scratch(spark, "gru-read")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), train.alias("train"), F.col(text).alias("text"))
    texts.mapInArrow(run, READ).write.partitionBy("kind").option("compression", "snappy").parquet(path)
    return spark.read.schema(READ).parquet(path)


def fit(rows: DataFrame, sample: int = SAMPLE) -> Gru | None:
    """The start: about ``sample`` training texts of read() chosen by a hash of their id, a stretch of each; None without words."""
    train = rows.where("kind = 'doc' and train")
    n = train.count()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for x in b.column(1).to_pylist():
                ids = np.frombuffer(x, "<u2").astype(np.int32)
                start = zlib.crc32(ids.tobytes()) % max(1, len(ids) - SAMPLE_TOKENS)
                got.append(ids[start : start + SAMPLE_TOKENS].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["id", "ids"])

    chosen = train.where(draw("doc_id", "gru-sample") < sample / max(n, 1)).select(F.col("doc_id").cast("string").alias("id"), "numbers")
    rows_of = sorted((r["id"] or "", bytes(r["ids"])) for r in chosen.mapInArrow(cut, "id string, ids binary").collect())
    flat = np.concatenate([np.frombuffer(b"\0\0\0\0" + x, np.int32) for _, x in rows_of] or [np.zeros(0, np.int32)])
    lanes = max(1, min(LANES, len(flat) // (2 * STEPS)))
    if len(flat) < 2 * lanes:
        return None
    model = Gru.new()
    use = len(flat) // lanes
    model.learn(flat[: use * lanes].reshape(lanes, use).copy())
    return model


def spread(rows: DataFrame, model: Gru) -> Gru:
    """The model after one pass over every training text of read(): each task learns on from model, and the weights are averaged.

    Every token is learned from once, the ends of texts too. The averaging is done by parts of the weights in tasks of
    their own, so one set of weights comes to the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = list(model.weights)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Gru({k: v.copy() for k, v in shared.value.weights.items()})
        held, amount, learned = [np.zeros(1, np.uint16)], 1, 0

        def take() -> None:
            """Learns from all tokens held; the last, as what comes before the next, and what fills no lanes stay."""
            nonlocal held, amount, learned
            flat = np.concatenate(held)
            lanes = max(1, min(WIDE, len(flat) // (2 * STEPS)))
            use = (len(flat) - 1) // lanes
            if use:
                net.learn(np.stack([flat[k * use : k * use + use + 1] for k in range(lanes)]), epochs=1, rate=1e-3)
                learned += use * lanes
            held = [flat[use * lanes :]]
            amount = len(held[0])

        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(np.frombuffer(x, "<u2"))
                amount += len(held[-1])
                if amount >= WIDE * LANE:
                    take()
        while amount > 1:
            take()
        flat = np.concatenate([net.weights[k].ravel() for k in names])
        parts = [x.astype("<f4").tobytes() for x in np.array_split(flat, PARTS)]
        if learned:
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([learned] * PARTS, pa.int64()), pa.array(parts, pa.binary())], names=["part", "n", "weights"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Any] = {}
        for b in batches:
            for part, n, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                mass, total = sums.get(part, (0, 0.0))
                sums[part] = mass + n, total + n * np.frombuffer(raw, "<f4").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(t / n).astype("<f4").tobytes() for n, t in sums.values()], pa.binary())], names=["part", "weights"])

    learned = stored(rows.where("kind = 'doc' and train").select("numbers").mapInArrow(learn, "part int, n long, weights binary"), "gru-parts", compression="none")
    parts = learned.repartition("part").mapInArrow(average, "part int, weights binary").collect()
    if not parts:
        return model
    flat, out, at = np.concatenate([np.frombuffer(r["weights"], "<f4") for r in sorted(parts, key=lambda r: r["part"])]), {}, 0
    for k in names:
        size = model.weights[k].size
        out[k] = flat[at : at + size].reshape(model.weights[k].shape).copy()
        at += size
    return Gru(out)


SCORED_ROWS = "rid long, doc_id long, n_tokens long, known long, base double, classed double, model double"


def score(rows: DataFrame, counts: Counts, model: Gru | None, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row for each text of read().

    Words outside the head, which read() left as (row, word, times), meet their counts in one join.
    """
    texts = rows.where("kind = 'doc'").select("rid", "doc_id", "n_tokens", "known", "base", "classed", "numbers")
    if model:
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net, held, amount = shared.value, [], 0

            def flushed() -> pa.RecordBatch:
                nonlocal amount
                logs = net.scores([x for _, numbers in held for x in numbers]) / np.log(10)
                got = pa.Table.from_batches([b for b, _ in held]).append_column("model", pa.array(logs, pa.float64()))
                held.clear()
                amount = 0
                return got.combine_chunks().to_batches()[0]

            for b in batches:
                if not b.num_rows:
                    continue
                numbers = [np.frombuffer(x, "<u2") for x in b.column(6).to_pylist()]
                held.append((b.drop_columns("numbers"), numbers))
                amount += sum(len(x) for x in numbers)
                if amount >= TOGETHER:
                    yield flushed()
            if held:
                yield flushed()

        texts = stored(texts.mapInArrow(run, SCORED_ROWS), "gru-scores")
    outside = rows.where("kind = 'word'").select("rid", "word", "n").join(vocabulary, "word", "left")
    log_count = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ADD))
    sums = outside.groupBy("rid").agg(F.sum(F.col("n") * log_count).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("met"))
    level = float(np.log10(counts.tokens + ADD * (counts.distinct + 1)))
    joined = texts.join(sums, "rid", "left")
    rare = F.coalesce("rare", F.lit(0.0))
    base = F.col("base") + rare - F.col("n_tokens") * F.lit(level)
    return joined.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).cast("long").alias("n_known"), base.alias("base_score"), (F.col("model") + F.col("classed") + rare if model else base).alias("score"))


def query(docs: DataFrame) -> DataFrame:
    trains = remainder("doc_id", 10) != 0
    small_batches(docs.sparkSession)
    vocabulary = stored(count_words(docs.where(trains)), "gru-vocabulary")
    counts = summarise(vocabulary)
    rows = read(docs, counts, trains)
    model = fit(rows) if counts.head else None
    out = score(rows, counts, spread(rows, model) if model else None, vocabulary)
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
