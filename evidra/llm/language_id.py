"""Language ID by a convolutional network over bytes, trained here in numpy and applied to fixed-length windows.

Filters of several widths slide over one-hot bytes; the largest response of each filter in a window goes through a
softmax layer. A text's prediction averages the log-probabilities of all its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import one_blas_thread, remainder, sampled, small_batches

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 256
STRIDE = WINDOW - max(WIDTHS) + 1
#: Bound of the training sample: about so many documents of each label, so many windows of each.
PER_LABEL, WINDOWS_OF_EACH = 1500, 2
UNKNOWN = "und"
#: Windows that go through the filters together.
BLOCK = 128


def windows(raw: bytes) -> np.ndarray:
    """All windows of the bytes, overlapping so that no filter position is lost; the last is padded with zeros."""
    n = max(1, -(-max(0, len(raw) - (WINDOW - STRIDE)) // STRIDE))
    flat = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, WINDOW), (STRIDE, 1))


@dataclass
class ByteConvNet:
    """filters[w]: (w, 256, FILTERS); dense: (len(WIDTHS) * FILTERS, labels)."""

    labels: list[str]
    filters: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def _pairs(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width, tables over byte pairs (or single bytes) by offset: fewer look-ups a position."""
        if not hasattr(self, "_tables"):
            self._tables = {}
            for w, f in self.filters.items():
                parts = [(j, (f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, w - 1, 2)]
                self._tables[w] = parts + [(w - 1, f[w - 1])] * (w % 2)
        return self._tables

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest response of each filter: (n, len(WIDTHS) * FILTERS)."""
        cols = np.ascontiguousarray(x.T).astype(np.intp)
        pairs = cols[:-1] * 256 + cols[1:]
        out = []
        for w, parts in self._pairs().items():
            n = WINDOW - w + 1
            total = None
            for j, t in parts:
                got = t.take(pairs[j : j + n] if len(t) == 65536 else cols[j : j + n], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            out.append(total.reshape(n, -1).max(axis=0).reshape(len(x), -1))
        return np.concatenate(out, axis=1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        return log_softmax(np.maximum(self.pooled(x), 0) @ self.dense + self.bias)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, labels: Sequence[str], steps: int = 600, rate: float = 0.05, seed: int = 7) -> ByteConvNet:
    """Adagrad on cross-entropy for at least so many steps and four epochs; the gradient of a pooled response reaches the bytes of its best position."""
    one_blas_thread()
    rng = np.random.default_rng(seed)
    net = ByteConvNet(
        list(labels), {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32),
    )
    sums = {id(p): np.full(p.shape, 0.1, np.float32) for p in [*net.filters.values(), net.dense, net.bias]}

    def update(p: np.ndarray, g: np.ndarray) -> None:
        sums[id(p)] += g * g
        p -= rate * g / np.sqrt(sums[id(p)])

    column = np.arange(FILTERS)
    for _ in range(max(4, -(-steps * 64 // len(x)))):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            xb, best, hidden = x[rows], {}, []
            for w, f in net.filters.items():
                n = WINDOW - w + 1
                total = sum(f[j].take(xb[:, j : j + n], axis=0) for j in range(w))
                best[w] = total.argmax(axis=1)
                hidden.append(np.take_along_axis(total, best[w][:, None, :], 1)[:, 0])
            h = np.maximum(np.concatenate(hidden, axis=1), 0)
            g = np.exp(log_softmax(h @ net.dense + net.bias))
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            gh = (g @ net.dense.T) * (h > 0)
            update(net.dense, h.T @ g)
            update(net.bias, g.sum(axis=0))
            for k, (w, f) in enumerate(net.filters.items()):
                part, gf = gh[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(f)
                for j in range(w):
                    np.add.at(gf[j], (np.take_along_axis(xb, best[w] + j, 1), np.broadcast_to(column, part.shape)), part)
                update(f, gf)
    return net


def fit(docs: DataFrame, label: str = "lang", id_column: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> ByteConvNet | None:
    """Learns from a bounded, hash-chosen sample of docs; None if no row has both a text and a label."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.length(text) > 0).select(id_column, text, F.col(label).cast("string").alias("label"))
    chosen = sampled(rows, "label", per_label, "language-id", id_column).select(F.col(id_column).cast("string").alias("id"), text, "label")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list[Any]] = {"id": [], "label": [], "window": []}
            for key, t, lab in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found = windows(t.encode())
                rng = np.random.default_rng(len(t))
                for k in rng.permutation(len(found))[:WINDOWS_OF_EACH]:
                    out["id"].append(key), out["label"].append(lab), out["window"].append(found[k].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.string()), ("label", pa.string()), ("window", pa.binary())]))

    got = sorted((r["label"], r["id"] or "", bytes(r["window"])) for r in chosen.mapInArrow(cut, "id string, label string, window binary").collect())
    if not got:
        return None
    labels = sorted({lab for lab, _, _ in got})
    x = np.frombuffer(b"".join(w for _, _, w in got), np.uint8).reshape(len(got), WINDOW)
    return train(x, np.array([labels.index(lab) for lab, _, _ in got]), labels)


def has_letter(text: str) -> bool:
    """Whether any character is a letter (a Unicode category L*); digits, fractions, numerals and marks are none."""
    return text.isalpha() or any(map(str.isalpha, text))


def classify(texts: Sequence[str | None], net: ByteConvNet | None) -> list[tuple[str, float]]:
    """(label, probability) of each whole text; UNKNOWN with 0 for null, letterless or unlearned."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    rows = [k for k, t in enumerate(texts) if t and has_letter(t)]
    held, count, owners, sums = [], 0, [], np.zeros((len(texts), len(net.labels)))

    def flush() -> None:
        nonlocal held, count, owners
        x = np.concatenate(held)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            weight = np.maximum((part != 0).sum(axis=1), 1)
            np.add.at(sums, np.concatenate(owners)[at : at + BLOCK], net.log_probabilities(part) * weight[:, None])
        held, count, owners = [], 0, []

    lengths = np.ones(len(texts))
    for k in rows:
        raw = texts[k].encode()
        lengths[k] = len(raw)
        w = windows(raw)
        held.append(w), owners.append(np.full(len(w), k))
        count += len(w)
        if count >= 32 * BLOCK:
            flush()
    if held:
        flush()
    p = np.exp(log_softmax(sums / lengths[:, None]))
    for k in rows:
        best = int(p[k].argmax())
        out[k] = (net.labels[best], float(min(1.0, p[k, best])))
    return out


def predict(docs: DataFrame, net: ByteConvNet | None, id_column: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..., lang_pred, score), one row for each row of docs; other columns are not read."""
    small_batches(docs.sparkSession)
    names = ["k0", *[f"k{i + 1}" for i in range(len(keep))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for b in batches:
            got = classify(b.column(0).to_pylist(), net)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())], names=[*names, "lang_pred", "score"])

    source = docs.select(F.col(text).alias("_text"), *[F.col(c).alias(n) for c, n in zip((id_column, *keep), names, strict=True)])
    schema = T.StructType([f for f in source.schema.fields if f.name != "_text"]).add("lang_pred", "string").add("score", "double")
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, (id_column, *keep), strict=True)], "lang_pred", "score")


def query(docs: DataFrame) -> DataFrame:
    net = fit(docs.where(remainder("doc_id", 3) != 1))
    return predict(docs, net).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
