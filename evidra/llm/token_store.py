"""Content-addressed store of token ids.

A rolling hash cuts each document's ids into chunks, so equal passages give equal chunks wherever they stand. A chunk
that occurs once is kept with its document; a chunk that occurs again is kept once in the shared part, by its digest.
A document's recipe lists its chunk digests and the Merkle root over them, which reading back verifies. Recipes are
written in ascending document order, so that a running sum gives every document's place in the whole id stream.

Layout below the store's path: ``kind=doc`` (recipes with the chunks of their own) and ``kind=chunk`` (shared chunks).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, small_batches

END = 2
#: Ids the rolling hash looks back on; mean, least and most ids of a chunk.
LOOK, MEAN, LEAST, MOST = 16, 256, 64, 2048
DIGEST = 16
#: Words a worker remembers the ids of; the memory is emptied when full. Longer words are not kept.
REMEMBERED, LONG = 600_000, 48
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


_grown: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64; kept, and grown when more are asked for."""
    if base not in _grown or len(_grown[base]) < n:
        out = np.full(max(4096, 2 * n), base, np.uint64)
        out[0] = 1
        _grown[base] = np.multiply.accumulate(out)
    return _grown[base][:n]


def _candidates(ids: np.ndarray) -> np.ndarray:
    """Ends where the rolling hash of the last LOOK ids asks for a cut."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    sums = np.cumsum(mixed * _powers(_ODD_INVERSE, len(ids)), dtype=np.uint64)
    sums[LOOK:] -= sums[:-LOOK].copy()
    return np.flatnonzero((sums * _powers(_ODD, len(ids))) >> np.uint64(40) & np.uint64(MEAN - 1) == 0) + 1


def _chosen(candidates: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids: candidates no nearer than LEAST to the end before, and none farther than MOST."""
    out, last = [], 0
    for end in candidates:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST:
            last = end
            out.append(last)
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id array; they depend on the ids just before them alone, but for least and most."""
    return cuts_of(ids, [len(ids)])[0]


def cuts_of(ids: np.ndarray, sizes: Sequence[int]) -> list[list[int]]:
    """The cuts of arrays laid end to end. As LOOK is below LEAST, what stands before an array has no say in its cuts."""
    found, out, at = _candidates(ids), [], 0
    for n in sizes:
        first, last = np.searchsorted(found, (at + 1, at + n + 1))
        out.append(_chosen((found[first:last] - at).tolist() if n > LEAST else [], n))
        at += n
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: Sequence[bytes]) -> bytes:
    """Root over the digests; an odd last one is carried up. Of nothing: the digest of nothing."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


_packer, _opener = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(ids: np.ndarray) -> bytes:
    """Ids as compressed byte planes; the first byte counts the planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    return bytes([planes]) + _packer.compress(np.ascontiguousarray(raw[:, :planes].T).tobytes())


EMPTY = pack(np.array([], "<u4"))


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_opener.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 4), np.uint8)
    out[:, : data[0]] = raw.T
    return out.view("<u4").ravel()


#: A word of Latin letters that no normaliser recomposes, marks that a splitter cuts off behind a letter as one piece,
#: and texts whose letters may be lowered ahead: below U+0250, where lowering is a letter for a letter (not so U+0130).
PLAIN, MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+"), ".,|!?;:&%$#*"
BEHIND, SIMPLE = re.compile(f"[{re.escape(MARKS)}](?<=[A-Za-zÀ-ÖØ-öø-įı-ɏ].)[{re.escape(MARKS)}]*(?![^ ])"), re.compile("[\\x00-įı-ɏ]*")
PROBE = "The Häuser, ÉTÉ niño!! x.y ıß straße|| don't; 12ab &&& Zürich*** façade: Œuvre ŉ <|endoftext|> ǅ 12AB, X.Y!! 'S* l'Été. --ÀB;; (Œ)#a: ½B, .,C?! #*d. É'LL&"


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Seen(dict):
    """Ids of words, made when first asked for; long words are not kept."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__({"": b""})
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= LONG:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of whole texts by the tokenizers library, a word at a time with memory.

    For tokenizers whose tokens never cross white space (it drops blanks before it splits words), the ids of a text
    are those of its words one after the other. If the tokenizer also lowers letters and splits them from marks, simple
    texts are lowered and their marks split off as a whole, so that fewer different words are met, and plain words go to
    the library's model directly, without the cost of its whole pipeline; the whole pipeline is compared with that for
    every letter of PLAIN, alone, inside a word and before every mark, before it is relied on. Texts that hold letters
    beyond SIMPLE, or a special token once lowered, go to the pipeline as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowered, self.whole = _Seen(self._lowered), _Seen(self._whole)
        self.direct = True
        words = self.probe()
        theirs = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        self.direct = all(w.tobytes() == np.array(t.ids, "<u4").tobytes() for w, t in zip(self.encode(words), theirs, strict=True))
        self.forget()

    @staticmethod
    def probe() -> list[str]:
        letters = [c for c in map(chr, range(0x250)) if PLAIN.fullmatch(c)]
        return [*PROBE.split(" "), PROBE, *letters, *[f"ab{c}Ab" for c in letters], *[f"{c}{m}" for c in letters for m in MARKS], *[f"ab{m}{k}" for m in MARKS for k in MARKS]]

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _lowered(self, low: str) -> bytes:
        """Ids of a word of a lowered text: the model's if it is plain."""
        if low.isascii():
            if low.isalpha():
                return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
        elif PLAIN.fullmatch(low):
            return array("I", [t.id for t in self.model.tokenize("".join([self.letters[b] for b in low.encode()]))]).tobytes()
        return self._whole(low)

    def forget(self) -> None:
        for memory in (self.lowered, self.whole):
            memory.clear()
            memory[""] = b""

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        out = []
        if len(self.lowered) > REMEMBERED or len(self.whole) > REMEMBERED:
            self.forget()
        for t in texts:
            text = (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
            ids_of = self.whole.__getitem__
            if self.direct and (text.isascii() or SIMPLE.fullmatch(text)):
                low = text.lower()
                if not any(s in low for s in self.special):
                    text, ids_of = BEHIND.sub(r" \g<0>", low), self.lowered.__getitem__
            out.append(np.frombuffer(b"".join(map(ids_of, text.split(" "))), "<u4"))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("sizes", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary())), ("data", pa.binary())])


def encode(docs: DataFrame, make: Callable[[], WordEncoder], end: int | None, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, sizes, digests, data): chunked and packed ids of each whole text, null as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([] if end is None else [end], "<u4")
        own = make()
        for b in batches:
            rows: dict[str, list[Any]] = {n: [] for n in ENCODED.names[1:]}
            texts = [part for ids in own.encode(b.column(1).to_pylist()) for part in (ids, tail)]
            joined, lengths = np.concatenate([tail[:0], *texts]), [len(i) + len(tail) for i in texts[::2]]
            raw, start = joined.tobytes(), 0
            for n, ends in zip(lengths, cuts_of(joined, lengths), strict=True):
                places = [4 * (start + e) for e in (0, *ends)]
                rows["n_tokens"].append(n), rows["sizes"].append(np.diff([0, *ends]).tolist()), rows["data"].append(pack(joined[start : start + n]))
                rows["digests"].append([digest(raw[a:z]) for a, z in zip(places, places[1:], strict=False)])
                start += n
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, ENCODED.field(k).type) for k, v in rows.items()]], schema=ENCODED)

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n_tokens long, sizes array<int>, digests array<binary>, data binary")


PACKED = "kind string, pack int, doc_id long, rid long, place long, n_tokens long, sizes array<int>, digests array<binary>, shared array<int>, root binary, digest binary, data binary"


def _write_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document: each encoded document, then (at most one row) which of its chunks are shared or owned."""
    number, place, waiting = TaskContext.get().partitionId(), 0, None
    names = [f.split()[0] for f in PACKED.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    rows: list[tuple[Any, ...]] = []

    def finish(row: tuple[Any, ...], shared: list[int], owned: list[int]) -> None:
        nonlocal place
        doc_id, rid, n_tokens, sizes, digests, data = row
        if shared:
            ids, ends = unpack(data), [0, *accumulate(sizes)]
            rows.extend(("chunk", number, None, None, None, sizes[k], None, None, None, None, digests[k], pack(ids[ends[k] : ends[k + 1]])) for k in owned)
            gone = set(shared)
            own = [ids[ends[k] : ends[k + 1]] for k in range(len(sizes)) if k not in gone]
            data = pack(np.concatenate(own)) if own else EMPTY
        rows.append(("doc", number, doc_id, rid, place, n_tokens, sizes, digests, shared, merkle_root(digests), None, data))
        place += n_tokens

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for b in batches:
        for *row, shared, owned in zip(*[b.column(n).to_pylist() for n in ("doc_id", "rid", "n_tokens", "sizes", "digests", "data", "shared", "owned")], strict=True):
            if row[-1] is not None:
                if waiting:
                    finish(waiting, [], [])
                waiting = row
            else:
                finish(waiting, shared, owned)
                waiting = None
        if len(rows) >= 256:
            yield batch()
    if waiting:
        finish(waiting, [], [])
    if rows:
        yield batch()


def write(docs: DataFrame, make: Callable[[], WordEncoder], end: int | None, path: str) -> None:
    """Writes the store of docs (doc_id, text) below path.

    Rows that repeat an id are documents of their own, in the order of the input's files. Digests alone are grouped to
    find what is shared (counts are summed before the shuffle); ids are moved once, into their order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    loose = scratch(spark, "token-encoded")
    encode(docs, make, end).withColumn("rid", F.monotonically_increasing_id()).write.option("compression", "none").parquet(loose)
    encoded = spark.read.parquet(loose)
    uses = encoded.select("doc_id", "rid", F.posexplode("digests").alias("at", "digest"))
    owners = uses.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("owner")).where("n > 1")
    marks = uses.join(owners, "digest").groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list("at")).alias("shared"), F.sort_array(F.collect_list(F.expr("CASE WHEN owner.rid = rid AND owner.at = at THEN at END"))).alias("owned"))
    both = encoded.select("doc_id", "rid", "n_tokens", "sizes", "digests", "data").unionByName(marks, allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartitionByRange(parts, F.col("doc_id"), F.col("rid")).sortWithinPartitions(F.col("doc_id"), F.col("rid"), F.col("data").isNull())
    ordered.mapInArrow(_write_packs, PACKED).write.partitionBy("kind").option("compression", "none").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(loose)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _read_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document: a recipe, then its shared chunks by position."""
    recipe, chunks = None, {}
    out: dict[str, list[Any]] = {k: [] for k in ("rid", "ids_crc32", "verified", "n_read")}

    def finish() -> None:
        rid, sizes, digests, root, data = recipe
        own, raw, at = unpack(data).tobytes(), [], 0
        for k, size in enumerate(sizes):
            if k in chunks:
                raw.append(unpack(chunks[k]).tobytes())
            else:
                raw.append(own[at : at + 4 * size])
                at += 4 * size
        leaves = [digest(r) for r in raw]
        whole = b"".join(raw)
        good = leaves == digests and merkle_root(leaves) == root and at == len(own) and len(whole) == 4 * sum(sizes)
        out["rid"].append(rid), out["ids_crc32"].append(zlib.crc32(whole)), out["verified"].append(good), out["n_read"].append(len(whole) // 4)

    def batch() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(out["rid"], pa.int64()), pa.array(out["ids_crc32"], pa.int64()), pa.array(out["verified"], pa.bool_()), pa.array(out["n_read"], pa.int64())], names=list(out))
        for v in out.values():
            v.clear()
        return got

    for b in batches:
        for *row, place in zip(*[b.column(n).to_pylist() for n in ("rid", "sizes", "digests", "root", "data", "at")], strict=True):
            if row[1] is not None:
                if recipe:
                    finish()
                recipe, chunks = row, {}
            else:
                chunks[place] = row[-1]
        yield batch()
    if recipe:
        finish()
        yield batch()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified, n_chunks, n_shared) per stored document, from the files alone."""
    small_batches(spark)
    stored = spark.read.schema(PACKED).parquet(path)
    recipes = stored.where("kind = 'doc'").select("pack", "doc_id", "rid", "place", "n_tokens", "sizes", "digests", "shared", "root", "data")
    chunks = stored.where("kind = 'chunk'").select("digest", "data")
    wanted = recipes.where(F.size("shared") > 0).select("rid", F.explode("shared").alias("at"), "digests").select("rid", "at", F.element_at("digests", F.col("at") + 1).alias("digest"))
    found = wanted.join(chunks, "digest").select("rid", "at", "data")
    needed = ["rid", "sizes", "digests", "root", "data"]
    alone = recipes.where(F.size("shared") == 0).select(*needed, F.lit(None).cast("int").alias("at"))
    mixed = recipes.where(F.size("shared") > 0).select(*needed).unionByName(found, allowMissingColumns=True)
    mixed = mixed.repartition(F.col("rid")).sortWithinPartitions(F.col("rid"), F.col("at").asc_nulls_first())
    schema = "rid long, ids_crc32 long, verified boolean, n_read long"
    checked = alone.mapInArrow(_read_packs, schema).unionByName(mixed.select(*needed, "at").mapInArrow(_read_packs, schema))
    totals = recipes.groupBy("pack").agg(F.sum("n_tokens").alias("total"))
    offsets = totals.select("pack", (F.sum("total").over(Window.orderBy("pack")) - F.col("total")).alias("offset"))  # a row for each file
    listed = recipes.select("pack", "doc_id", "rid", "place", "n_tokens", F.size("digests").alias("n_chunks"), F.size("shared").alias("n_shared"))
    start: Column = F.col("offset") + F.col("place")
    return listed.join(F.broadcast(offsets), "pack").join(checked, "rid").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", (F.col("verified") & (F.col("n_read") == F.col("n_tokens"))).alias("verified"), "n_chunks", "n_shared")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = scratch(spark, "token-store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), lambda: encoder(tokenizer), END, path)
    return read(spark, path)
