"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie, byte fallback, whitespace marker.

A text becomes marker + text with every space a marker. No piece has a marker after another character, so the best
segmentation of a text is that of its marker-led segments one after the other. Each batch finds its new distinct
segments and runs Viterbi over all of them at once, a position and a trie step at a time, in numpy.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

MARK = "▁"
#: What a character outside the vocabulary scores below the lowest piece.
PENALTY = 10.0
#: Distinct segments remembered by a worker; the memory is emptied when full.
REMEMBERED = 150_000
#: Places of a group of segments that are walked together, and signs of the texts that are cut into segments at once.
CELLS, SIGNS = 1 << 18, 1 << 20
SEGMENT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


@dataclass
class Trie:
    """Double array: the child of state s by byte c is base[s] + c + 1 if check of that is s; value: piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, keys: dict[bytes, int]) -> Trie:
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, number in keys.items():
            at = 0
            for c in key:
                at = nodes[at].setdefault(c, len(nodes))
                if at == len(nodes):
                    nodes.append({})
                    ends.append(-1)
            ends[at] = number
        size = 2 * len(nodes) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], value[0] = 0, ends[0]
        place, free, end = {0: 0}, 1, 1
        for node, children in enumerate(nodes):  # parents come before their children
            if not children:
                continue
            codes, state = sorted(c + 1 for c in children), place[node]
            while check[free] >= 0:
                free += 1
            slot, tries = free, 0
            while True:
                tries += 1
                slot = max(slot, end) if tries > 64 else slot  # rather a little space than a long search
                b = slot - codes[0]
                if b + 257 >= size:
                    base, check, value, size = base + [0] * size, check + [-1] * size, value + [-1] * size, 2 * size
                if b >= 0 and all(check[b + c] < 0 for c in codes):
                    break
                slot += 1
            base[state], end = b, max(end, b + codes[-1] + 1)
            for c, child in children.items():
                check[b + c + 1], value[b + c + 1], place[child] = state, ends[child], b + c + 1
        return cls(np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32))


@dataclass
class Pieces:
    """A vocabulary: what each id spells (with the marker), its log score, its kind, and the trie of normal pieces."""

    spelled: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    trie: Trie
    prefix: bool = True
    seen: dict[str, tuple[bytes, float]] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, pieces: Sequence[tuple[str, float, str]], prefix: bool = True) -> Pieces:
        """pieces: (text, log score, kind) by id; kind is normal, byte, control or unknown."""
        byte_ids, spelled = np.full(256, -1, np.int64), []
        for k, (text, _, kind) in enumerate(pieces):
            if kind == "byte":
                byte_ids[int(text[3:5], 16)] = k
            spelled.append(bytes([int(text[3:5], 16)]) if kind == "byte" else text.replace(MARK, " ").encode() if kind == "normal" else b"")
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no piece for some byte")
        if any(MARK in t.lstrip(MARK) or ("\n" in t and t != "\n") for t, _, kind in pieces if kind == "normal"):
            raise ValueError("a piece has a marker or line end inside")
        keys = {t.encode(): k for k, (t, _, kind) in enumerate(pieces) if kind == "normal"}
        return cls(spelled, np.array([s for _, s, _ in pieces]), byte_ids, Trie.of(keys), prefix)

    @classmethod
    def load(cls, path: str, scores: str = "zipf") -> Pieces:
        """From a model file of the sentencepiece library.

        scores "file" takes the file's own; "zipf" turns the order of the normal pieces into log probabilities
        (-log of rank plus two, normalised), for files whose scores are merge ranks.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = ["byte" if model.is_byte(k) else "control" if model.is_control(k) else "unknown" if model.is_unknown(k) else "normal" for k in range(model.get_piece_size())]
        values = [model.get_score(k) for k in range(len(kinds))]
        if scores == "zipf":
            normal = [k for k, x in enumerate(kinds) if x == "normal"]
            own = -np.log(np.arange(len(normal)) + 2.0)
            own -= np.log(np.exp(own).sum())
            for k, v in zip(normal, own, strict=True):
                values[k] = float(v)
        return cls.of([(model.id_to_piece(k), values[k], kinds[k]) for k in range(len(kinds))])

    def viterbi(self, segments: Sequence[str]) -> list[tuple[bytes, float]]:
        """(ids as little-endian 32-bit integers, score) of each segment."""
        out: list[tuple[bytes, float]] = [(b"", 0.0)] * len(segments)
        raw = [s.encode() for s in segments]
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        at = 0
        while at < len(order):
            longest = max(16, 2 * len(raw[order[at]]))
            stop = at
            while stop < len(order) and len(raw[order[stop]]) <= longest and (stop - at) * longest < CELLS:
                stop += 1
            group = order[at:stop]
            for k, got in zip(group, self._together([raw[k] for k in group]), strict=True):
                out[k] = got
            at = stop
        return out

    def _together(self, raw: list[bytes]) -> list[tuple[bytes, float]]:
        n, width = len(raw), len(raw[-1])
        grid = np.zeros((width + 1, n), np.uint8)  # by position, then segment; a zero row ends every walk below
        lengths = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(n, width)
        grid[:width] = flat.T
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        came, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        normal = self.scores[value[value >= 0]]
        unknown = (normal.min() if len(normal) else 0.0) - PENALTY
        for i in range(width):
            rows = np.flatnonzero((lengths > i) & (best[i] > -np.inf))
            if not len(rows):
                continue
            lead = grid[i, rows]
            size = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(rows), bool)
            here, state, who = best[i], np.zeros(len(rows), np.int32), np.arange(len(rows))
            for k in range(i, width):
                step = base[state] + grid[k, rows[who]] + 1
                good = (check[step] == state) & (lengths[rows[who]] > k)
                if not good.any():
                    break
                who, state = who[good], step[good]
                number = value[state]
                ends = number >= 0
                if ends.any():
                    own, ids = who[ends], number[ends]
                    cols = rows[own]
                    single[own[size[own] == k + 1 - i]] = True
                    total = here[cols] + self.scores[ids]
                    better = total > best[k + 1, cols]
                    cols = cols[better]
                    best[k + 1, cols], came[k + 1, cols], piece[k + 1, cols] = total[better], i, ids[better]
            for length in (1, 2, 3, 4):
                cols = rows[~single & (size == length)]
                if len(cols) and i + length <= width:
                    total = here[cols] + unknown
                    better = total > best[i + length, cols]
                    cols = cols[better]
                    best[i + length, cols], came[i + length, cols], piece[i + length, cols] = total[better], i, -1
        out = []
        back_to, used, ends = came.T.tolist(), piece.T.tolist(), lengths.tolist()
        for k, r in enumerate(raw):
            at, ids = ends[k], []
            while at > 0:
                start, number = back_to[k][at], used[k][at]
                if number >= 0:
                    ids.append(number)
                else:
                    ids.extend(self.byte_ids[b] for b in reversed(r[start:at]))
                at = start
            out.append((np.array(ids[::-1], "<u4").tobytes(), float(best[ends[k], k])))
        return out

    def encode(self, texts: Iterable[str | None]) -> list[tuple[bytes, float]]:
        """(ids as little-endian 32-bit integers, log score) of each whole text.

        None and the empty text have no ids. A marker character in the text itself goes to byte pieces, so that
        decoding gives back every text exactly.
        """
        cut, literal = [], [np.array([self.byte_ids[b] for b in MARK.encode()], "<u4").tobytes()]
        for t in texts:
            parts: list[str | None] = []
            for k, piece in enumerate((t or "").split(MARK)):
                parts += [None] * (k > 0)
                marked = piece.replace(" ", MARK)
                marked = MARK + marked if self.prefix and k == 0 and t else marked
                parts += SEGMENT.findall(marked)
            cut.append(parts)
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        fresh = [s for s in {s for parts in cut for s in parts if s is not None} if s not in seen]
        seen.update(zip(fresh, self.viterbi(fresh), strict=True))
        seen[None] = (literal[0], 0.0)  # type: ignore[index]
        out = []
        for parts in cut:
            got = [seen[s] for s in parts]  # type: ignore[index]
            out.append((b"".join([x for x, _ in got]), sum([s for _, s in got])))
        for s in fresh:
            if len(s) > 48:
                del seen[s]
        return out

    def decode(self, ids: bytes | Sequence[int]) -> str:
        """The text of ids; the first marker, if the vocabulary adds one, is dropped."""
        numbers = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else list(ids)
        raw = b"".join(map(self.spelled.__getitem__, numbers))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def encoded(voc: Pieces, texts: Sequence[str | None]) -> Iterator[tuple[bytes, float]]:
    """voc.encode of the texts, some at a time, so that the segments of a whole batch are never held at once."""
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= SIGNS:
            yield from voc.encode(held)
            held, size = [], 0
    yield from voc.encode(held)


def encode_texts(docs: DataFrame, vocabulary: Pieces, id_column: str = "doc_id", text: str = "text", keep: Sequence[str] = (), ids: bool = False) -> DataFrame:
    """(id, keep..., [piece_ids], n_pieces, n_bytes_fallback, ids_crc32, score, round_trip): one row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    names = [f"k{k}" for k in range(1 + len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        fallback = np.zeros(len(voc.spelled), bool)
        fallback[voc.byte_ids] = True
        for b in batches:
            texts = b.column(0).to_pylist()
            out: dict[str, list[Any]] = {"n_pieces": [], "n_bytes_fallback": [], "ids_crc32": [], "score": [], "round_trip": []}
            numbers = []
            for t, (packed, total) in zip(texts, encoded(voc, texts), strict=True):
                got = np.frombuffer(packed, "<u4")
                out["n_pieces"].append(len(got)), out["n_bytes_fallback"].append(int(fallback[got].sum()))
                out["ids_crc32"].append(zlib.crc32(packed)), out["score"].append(total), out["round_trip"].append(voc.decode(packed) == (t or ""))
                if ids:
                    numbers.append(got.astype(np.int32))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            extra = [pa.array(numbers, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *extra, *[pa.array(v, k) for v, k in zip(out.values(), types, strict=True)]], names=[*names, *["piece_ids"] * ids, *out])

    source = docs.select(F.col(text).alias("_text"), *[F.col(c).alias(n) for c, n in zip((id_column, *keep), names, strict=True)])
    schema = T.StructType([f for f in source.schema.fields if f.name != "_text"])
    for name, kind in [*[("piece_ids", T.ArrayType(T.IntegerType()))] * ids, ("n_pieces", "long"), ("n_bytes_fallback", "long"), ("ids_crc32", "long"), ("score", "double"), ("round_trip", "boolean")]:
        schema = schema.add(name, kind)
    got = source.mapInArrow(run, schema)
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, (id_column, *keep), strict=True)], *got.columns[len(names) :])


def vocabulary(path: str | None = None) -> Pieces:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Pieces.load(path)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(path))
