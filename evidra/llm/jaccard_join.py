"""Exact n-gram Jaccard self-join by grouped prefixes, returning classes instead of pairs.

Documents with equal shingle sets are one node. A node's shingles are put in one order for all (common ones last); two
nodes at the threshold share one of their first shingles. Nodes with the same prefix and size form a group that enters
the index once; group pairs are filtered by size and position, then expanded. A parity sketch of each set bounds the
difference of two sets from below, so that nearly all pairs left are linked; whole sets verify them.

Classes need no link inside a class twice: a first round verifies each node with its nearest one in a few of the lists
they share, further rounds the nearest pairs of two classes in all lists, until none is linked; then all pairs whose
ends are still in different classes are enumerated, so that no link between them is missed, and large groups of near
copies leave rows in proportion to their size. Long lists are dealt out in blocks.

Null, empty and blank texts have no shingles and are alone; texts of any length are taken whole; equal texts are one
node; rows that repeat an id are documents of their own; an empty table gives no rows; columns of docs that are not
asked for never enter, and those asked for (``keep``) are renamed on the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import at_least, forget, scratch, small_batches, stored, words
from .graph import components

#: Shingles put last in the order: the commonest of those met so often among the different texts of one piece of a
#: partition. They steer cost alone; results do not depend on them.
COMMON, MET = 1 << 17, 4
#: Shingles counted together in a partition.
PIECE = 1_000_000
#: Entries of a list looked at together in the round that verifies nearest nodes only, and in the last.
NEAR_BLOCK, BLOCK = 1024, 4096
#: Ids that are broadcast; with more, a shuffled join.
SENT = 500_000
#: Lists of each node, about, in the first of those.
PICKED = 8
#: Rows of a block compared at once with the whole block; lists up to SHORT entries are compared side by side.
STRIP, SHORT = 256, 16
#: Rounds of nearest entries at most, before all pairs across classes are enumerated.
ROUNDS = 5
#: Bits of a list entry's parity sketch; a node's own sketch has at least as many bits as shingles.
SKETCH = 512


@dataclass(frozen=True)
class Join:
    """Shingles of ``width`` words; a link where percent * union <= 100 * intersection."""

    width: int = 4
    percent: int = 85

    def prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1

    def least_overlap(self, a: Any, b: Any) -> Any:
        """The smallest intersection of linked sets of these sizes: whole numbers, arrays or columns."""
        share = self.percent * (a + b) + 99 + self.percent
        return F.floor(share / (100 + self.percent)) if isinstance(a, Column) else share // (100 + self.percent)


class _Hashes(dict):
    """Word hashes, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


_known = _Hashes()
_M = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle; none without words."""
    if len(_known) > 200_000:
        _known.clear()
    tokens = words(text)
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(_known.__getitem__, tokens), np.uint64, n)
    take = min(width, n)
    h = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        h += x[k : n - take + 1 + k] * _M[k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h.sort()
    fresh = np.empty(len(h), bool)
    fresh[0] = True
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    return h[fresh]


def digest_of(s: np.ndarray) -> bytes:
    """A 128-bit name of a shingle set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch_of(s: np.ndarray, bits: int = SKETCH) -> bytes:
    """bits (a power of two), each the parity of the members that fall on it: sets that differ in d members differ in at most d bits."""
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the halves of a longer one are folded onto each other, which keeps the bound."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    m = min(len(x), len(y))
    x, y = np.bitwise_xor.reduce(x.reshape(-1, m), axis=0), np.bitwise_xor.reduce(y.reshape(-1, m), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _survey(join: Join, schema: pa.Schema):
    """Rows (kind doc: row, n, digest and the columns kept) and (kind common: shingle, met) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, amount, texts, at = [], 0, set(), TaskContext.get().partitionId() << 40

        def counted() -> pa.RecordBatch:
            nonlocal held, amount, texts
            values, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = times >= MET
            k = int(often.sum())
            held, amount, texts = [], 0, set()
            given = {"kind": pa.array(["common"] * k, pa.string()), "shingle": pa.array(values[often].view(np.int64)), "met": pa.array(times[often].astype(np.int64))}
            return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(k, f.type)) for f in schema], schema=schema)

        for b in batches:
            n, digests = [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, join.width)
                n.append(len(s)), digests.append(digest_of(s))
                if len(s) and digests[-1] not in texts:
                    texts.add(digests[-1])
                    held.append(s)
                    amount += len(s)
                if amount >= PIECE:
                    yield counted()
            k = len(n)
            given = {"kind": pa.array(["doc"] * k, pa.string()), "row": pa.array(np.arange(at, at + k)), "n": pa.array(n, pa.int32()), "digest": pa.array(digests, pa.binary())}
            at += k
            kept = lambda f: b.column(f.name).cast(f.type) if f.name in b.schema.names else pa.nulls(k, f.type)
            yield pa.RecordBatch.from_arrays([given[f.name] if f.name in given else kept(f) for f in schema], schema=schema)
        yield counted()

    return run


def _prefixes(join: Join, common: np.ndarray, rank: np.ndarray):
    """Rows (digest, n, grouped, prefix, sketch, wide) of whole texts; common is sorted, rank is each one's place from rare to common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            rows: dict[str, list[Any]] = {"digest": [], "n": [], "grouped": [], "prefix": [], "sketch": [], "wide": []}
            for t in b.column(0).to_pylist():
                s = shingles(t, join.width)
                if not len(s) or (name := digest_of(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(name)
                at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
                usual = common[at] == s if len(common) else np.zeros(len(s), bool)
                p = join.prefix(len(s))
                head = s[~usual][:p]
                if len(head) < p:
                    late = s[usual]
                    head = np.concatenate([head, late[np.argsort(rank[at[usual]])[: p - len(head)]]])
                rows["digest"].append(name), rows["n"].append(len(s)), rows["prefix"].append(head.view(np.int64))
                rows["grouped"].append(digest_of(np.append(head, np.uint64(len(s))))), rows["sketch"].append(sketch_of(s))
                rows["wide"].append(sketch_of(s, max(SKETCH, 1 << (len(s) - 1).bit_length())))
            yield pa.RecordBatch.from_arrays([pa.array(rows["digest"], pa.binary()), pa.array(rows["n"], pa.int32()), pa.array(rows["grouped"], pa.binary()), pa.array(rows["prefix"], pa.list_(pa.int64())), pa.array(rows["sketch"], pa.binary()), pa.array(rows["wide"], pa.binary())], names=list(rows))

    return run


def _verify(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= join.percent * (len(both) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def _narrow(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            room = a + z - 2 * join.least_overlap(a.astype(np.int64), z.astype(np.int64))
            keep = pa.array([apart(x, y) <= most for x, y, most in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), room.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def _with_both(pairs: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """pairs (a, b) with columns of the nodes at either end, side by side."""
    at = lambda end: nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    return pairs.select("a", "b").join(at("a"), "a").join(at("b"), "b").select("a", "b", *[f"{c}_{end}" for c in columns for end in ("a", "b")])


def narrowed(pairs: DataFrame, sketches: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) that the nodes' own sketches (node, n, wide) allow to be linked."""
    return _with_both(pairs, sketches, ["n", "wide"]).mapInArrow(_narrow(join), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose whole sets (node, members) are linked."""
    return _with_both(pairs, sets, ["members"]).mapInArrow(_verify(join), "a long, b long")


def _compatible(join: Join, r: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of index pairs, those of different classes and groups that sizes, places and sketches allow, with the bits that differ."""
    ok = (r["own"][p] != r["own"][q]) & (r["grp"][p] != r["grp"][q])
    p, q = p[ok], q[ok]
    a, b = r["n"][p], r["n"][q]
    least = join.least_overlap(a, b)
    ok = (100 * np.minimum(a, b) >= join.percent * np.maximum(a, b)) & (np.minimum(r["most"][p], r["most"][q]) >= least)
    p, q, room = p[ok], q[ok], (a + b - 2 * least)[ok]
    bits = np.bitwise_count(r["sketch"][p] ^ r["sketch"][q]).sum(axis=1, dtype=np.int64)
    ok = bits <= room
    return p[ok], q[ok], bits[ok]


def _in_list(join: Join, r: dict[str, np.ndarray], a: int, z: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Compatible pairs of one list, a strip of rows with all after it; between two blocks, of one with the other."""
    first = np.flatnonzero(r["side"][a:z] == 0) + a
    second = np.flatnonzero(r["side"][a:z] == 1) + a
    inside = not len(second)
    for i in range(0, len(first), STRIP):
        x, y = first[i : i + STRIP], first[i:] if inside else second
        p, q = np.repeat(x, len(y)), np.tile(y, len(x))
        if inside:
            p, q = p[p < q], q[p < q]
        yield _compatible(join, r, p, q)


def _pairs(join: Join, nearest: bool):
    """Entries sorted by list and block, (token, x, y, side, n, node, most, grp, own, sketch): compatible pairs (a, b, bits).

    With nearest, of each entry the one with the fewest differing bits in its list (but one pair of two classes), and the one with the list's clearest
    entry: the one whose prefix has the fewest shingles of its own, which the copies of one text are nearest to. Each
    pair once in a task, but for what many pairs ago was passed on.
    """
    names = ["token", "x", "y", "side", "n", "node", "most", "grp", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            a, b, bits = (np.concatenate(c) for c in zip(*waiting, strict=True)) if waiting else (np.zeros(0, np.int64),) * 3
            waiting.clear()
            order = np.lexsort((b, a))
            a, b, bits = a[order], b[order], bits[order]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            return pa.RecordBatch.from_arrays([pa.array(v[fresh]) for v in (a, b, bits)], names=["a", "b", "bits"])

        def found(r: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, bits: np.ndarray) -> None:
            a, b = r["node"][p], r["node"][q]
            waiting.append((np.minimum(a, b), np.maximum(a, b), bits))

        def take(r: dict[str, np.ndarray]) -> None:
            """All whole lists of r."""
            new = np.ones(len(r["token"]), bool)
            new[1:] = (r["token"][1:] != r["token"][:-1]) | (r["x"][1:] != r["x"][:-1]) | (r["y"][1:] != r["y"][:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(new))
            long = (ends - starts > SHORT) | (r["x"][starts] != r["y"][starts])
            which = np.cumsum(new) - 1
            got = []
            for step in range(1, SHORT):
                p = np.flatnonzero((which[step:] == which[:-step]) & ~long[which[step:]])
                if not len(p):
                    break
                got.append(_compatible(join, r, p, p + step))
            for k in np.flatnonzero(long).tolist():
                for part in _in_list(join, r, int(starts[k]), int(ends[k])):
                    if nearest:
                        got.append(part)
                    elif len(part[0]):
                        found(r, *part)
            if not got:
                return
            p, q, bits = (np.concatenate(c) for c in zip(*got, strict=True))
            if nearest:
                order = np.lexsort((-r["most"] / r["n"], which))
                lead = order[starts][which]
                to_lead = np.flatnonzero((p == lead[p]) | (q == lead[q]))
                ends_of, pair = np.concatenate([p, q]), np.tile(np.arange(len(p)), 2)
                order = np.lexsort((np.tile(bits, 2), ends_of))
                _, firsts = np.unique(ends_of[order], return_index=True)
                chosen = np.union1d(pair[order[firsts]], to_lead)
                p, q, bits = p[chosen], q[chosen], bits[chosen]
                low, high = np.minimum(r["own"][p], r["own"][q]), np.maximum(r["own"][p], r["own"][q])
                order = np.lexsort((bits, high, low, which[p]))  # of two classes in a list the nearest pair: one link joins them
                low, high, at = low[order], high[order], which[p][order]
                best = np.ones(len(order), bool)
                best[1:] = (at[1:] != at[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
                p, q, bits = p[order[best]], q[order[best]], bits[order[best]]
            found(r, p, q, bits)

        rest: dict[str, np.ndarray] | None = None
        for b in batches:
            r = {name: b.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for name in names}
            r["sketch"] = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            if rest is not None:
                r = {name: np.concatenate([rest[name], v]) for name, v in r.items()}
            last = (r["token"] == r["token"][-1]) & (r["x"] == r["x"][-1]) & (r["y"] == r["y"][-1]) if len(r["token"]) else np.zeros(0, bool)
            cut = int(np.argmax(last)) if len(last) else 0
            if cut:
                take({name: v[:cut] for name, v in r.items()})
            rest = {name: v[cut:] for name, v in r.items()}
            if sum(len(w[0]) for w in waiting) >= 200_000:
                yield emit()
        if rest is not None and len(rest["token"]):
            take(rest)
        yield emit()

    return run


#: Ids of which a Bloom filter is sent to the scan; with more, texts are shuffled to the join instead.
FILTERED = 4_000_000
NO_ID = -(1 << 63)


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = keys.view(np.uint64) * _M[1]
    h ^= h >> np.uint64(32)
    h *= _M[2]
    for k in range(5):
        yield ((h >> np.uint64(8)) + np.uint64(k) * ((h >> np.uint64(36)) | np.uint64(1))) & np.uint64(bits - 1)


def _keys(column: Any) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _bloom(ids: DataFrame, n: int) -> tuple[Any, int]:
    """A broadcast Bloom filter of the column key, 12 to 24 bits a key; the partial filters are united in the tasks of a tree."""
    bits = 1 << max(13, (12 * max(n, 1)).bit_length())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _places(_keys(b.column(0)), bits):
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["bits"])

    held = np.zeros(bits // 8, np.uint8)
    for r in ids.coalesce(4).mapInArrow(fill, "bits binary").toLocalIterator():
        held |= np.frombuffer(r["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(held.tobytes()), bits


def _sets(join: Join, bloom: Any, bits: int):
    """(node, members) of the rows (key, text) that pass the filter, each set once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held = np.frombuffer(bloom.value, np.uint8) if bloom else None
        for b in batches:
            if held is not None and b.num_rows:
                good = np.ones(b.num_rows, bool)
                for at in _places(_keys(b.column(0)), bits):
                    good &= (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                b = b.filter(pa.array(good))
            names, members = [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, join.width)
                name = digest_of(s)
                if len(s) and name not in seen:
                    if len(seen) < 200_000:
                        seen.add(name)
                    names.append(name), members.append(s.astype("<u8", copy=False).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(members, pa.binary())], names=["digest", "members"])

    return run


def sets_of(source: DataFrame, asked: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """(node, members) of the nodes asked for, each from the texts with its smallest id."""
    wanted = stored(asked.join(nodes, "node").select("node", "digest", F.coalesce("least", F.lit(NO_ID)).alias("key")), "jaccard-wanted")
    keyed = source.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text")
    n = wanted.count()
    bloom, bits = _bloom(wanted.select("key"), n) if n <= FILTERED else (None, 0)
    if not bloom:
        keyed = keyed.join(wanted.select("key").distinct(), "key", "left_semi")
    found = keyed.mapInArrow(_sets(join, bloom, bits), "digest binary, members binary")
    out = stored(found.join(wanted.select("node", "digest"), "digest").select("node", "members"), "jaccard-sets", compression="none")
    forget(wanted)
    return out


def classed_rows(docs: DataFrame, join: Join = Join(), text: str = "text", id_column: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, *keep), one row for each row of docs.

    component_id is the smallest id of a class; a text without words is alone. Rows with a null id take part and have
    the class's smallest id (null if none has one). class_id numbers the classes of this run, null without words; it
    tells classes apart where ids repeat. Equal texts are one node, so repeats cost nothing. Hash equality stands for
    shingle equality (64 bits, compared within a pair only) and for set equality (128 bits).
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    others = [f for f in source.schema.fields if f.name != "text"]
    schema = T.StructType().add("kind", "string").add("row", "long").add("n", "integer").add("digest", "binary").add("shingle", "long").add("met", "long")
    schema = T.StructType([*schema.fields, *[T.StructField(f.name, f.dataType) for f in others]])
    path = scratch(spark, "jaccard-survey")
    source.mapInArrow(_survey(join, to_arrow_schema(schema)), schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    survey = spark.read.schema(schema).parquet(path)
    listed = survey.where("kind = 'doc'").select("row", "n", "digest", *[f.name for f in others])
    often = at_least(survey.where("kind = 'common'").groupBy("shingle").agg(F.sum("met").alias("met")), "met", COMMON).collect()
    values, met = np.array([r["shingle"] for r in often], np.int64).view(np.uint64), np.array([r["met"] for r in often], np.int64)
    by_value = np.argsort(values)
    common, met = values[by_value], met[by_value]
    rank = np.empty(len(common), np.int64)  # place in the order by how often met, then by hash
    rank[np.lexsort((common, met))] = np.arange(len(common))
    nodes = stored(listed.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "jaccard-nodes")

    found = source.select("text").mapInArrow(_prefixes(join, common, rank), "digest binary, n int, grouped binary, prefix array<long>, sketch binary, wide binary")
    prefixes = stored(found.dropDuplicates(["digest"]).join(nodes.select("digest", "node"), "digest").drop("digest"), "jaccard-prefixes")
    groups = stored(prefixes.groupBy("grouped").agg(F.min("node").alias("grp"), F.count("*").alias("held")), "jaccard-groups")
    others = stored(prefixes.select("grouped", "node").join(groups.where("held > 1"), "grouped").where("node <> grp").select("node"), "jaccard-others")
    others = F.broadcast(others) if others.count() <= SENT else others
    index = prefixes.join(others, "node", "left_anti").select(F.col("node").alias("grp"), "n", F.posexplode("prefix").alias("at", "token"))
    counted = index.groupBy("token").count().where("count > 1").select("token").hint("merge")  # grows with the input: not to be broadcast; AQE may split the join

    # Prefix shingles in no other prefix are in no partner that shares a later one: "most" bounds the intersection.
    # The smaller of a linked pair lacks few, so an entry matters only near the sizes of entries that can be the smaller.
    n = F.col("n")
    before = F.row_number().over(Window.partitionBy("grp").orderBy("at")) - 1
    live = stored(index.join(counted, "token").withColumn("most", n - (F.col("at") - before)), "jaccard-index")
    strong = F.when(F.col("most") >= join.least_overlap(n, n), n)
    near = live.groupBy("token").agg(F.min(strong).alias("low"), F.max(strong).alias("high"), F.count("*").alias("size")).where("low IS NOT NULL AND size > 1")
    chosen = live.join(near, "token").where((100 * n >= join.percent * F.col("low")) & (100 * F.col("high") >= join.percent * n))
    members = prefixes.join(groups, "grouped").select("grp", "node", "n", "held")
    # Lists of a first round: about PICKED for each node, the same for nodes alike, by the token's hash and the prefix's length.
    length = n - F.floor((join.percent * n + 99) / 100) + 1
    among = F.greatest(F.lit(PICKED), F.pow(2, F.ceil(F.log2(length.cast("double")))).cast("int"))
    expanded = chosen.select("token", "grp", "most").join(members.select("grp", "node", "n"), "grp").select("token", "n", "node", "most", "grp", (F.pmod(F.xxhash64("token"), among) < PICKED).alias("picked"))
    inside = members.where("held > 1").select(F.col("grp").alias("token"), "n", "node", n.alias("most"), F.col("node").alias("grp"), F.lit(True).alias("picked"))
    entries = stored(expanded.unionByName(inside), "jaccard-entries")
    sketches = prefixes.select("node", "sketch")
    forget(live, groups)

    def open_lists(entries: DataFrame, labels: DataFrame | None, block: int, all_blocks: bool) -> DataFrame:
        """Entries of lists that hold several classes, in blocks; with all_blocks, each block meets every other one."""
        named = entries.withColumn("own", F.col("node")) if labels is None else entries.join(labels, "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component")
        clearest = F.max_by("node", F.col("most") / F.col("n")).alias("clearest")
        lists = named.groupBy("token").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("held"), clearest).where("lo < hi")
        dealt = named.join(lists, "token").join(sketches, "node").withColumn("blocks", F.ceil(F.col("held") / block).cast("int"))
        dealt = dealt.withColumn("at", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        if all_blocks:
            dealt = dealt.withColumn("other", F.explode(every))
            dealt = dealt.withColumn("x", F.least("at", "other")).withColumn("y", F.greatest("at", "other")).withColumn("side", (F.col("at") != F.col("x")).cast("int"))
        else:
            dealt = dealt.withColumn("x", F.explode(F.when(F.col("node") == F.col("clearest"), every).otherwise(F.array("at")))).withColumn("y", F.col("x")).withColumn("side", F.lit(0))
        columns = ["token", "x", "y", "side", "n", "node", "most", "grp", "own", "sketch"]
        return dealt.select(*columns).repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")

    wide = prefixes.select("node", "n", "wide")

    def linked(pairs: DataFrame) -> DataFrame | None:
        """The links among pairs (a, b), None without any candidates."""
        close = stored(narrowed(pairs, wide, join), "jaccard-close")
        if close.isEmpty():
            return None
        sets = sets_of(source, close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, join)
        good = stored(verified(close, sets, join), "jaccard-links")
        forget(close, sets)
        return good

    def joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
        """links (a, b) and those that make the classes so far."""
        return links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))

    pair = "a long, b long, bits long"
    tried: DataFrame | None = None
    labels: DataFrame | None = None
    for _ in range(ROUNDS):  # classes met by their nearest pairs, until a round links none: what is left across them is little
        near = open_lists(entries.where("picked") if tried is None else entries, labels, NEAR_BLOCK, False).mapInArrow(_pairs(join, True), pair).select("a", "b").distinct()
        fresh = stored(near if tried is None else near.join(tried, ["a", "b"], "left_anti"), "jaccard-nearest")
        tried = fresh if tried is None else tried.unionByName(fresh)
        good = linked(fresh)
        if good is None or good.isEmpty():
            break
        labels = components(joined(good, labels))

    pairs = open_lists(entries, labels, BLOCK, True).mapInArrow(_pairs(join, False), pair)
    more = linked(stored(pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-across"))
    if more is not None:
        labels = components(joined(more, labels))

    forget(prefixes, entries)
    named = nodes.withColumn("component", F.col("node")) if labels is None else nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = named.join(smallest, "component").select("digest", "component_id", F.col("component").alias("class_id"))
    kept = [F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)]
    size = F.col("n").cast("long").alias("n_shingles")
    alone = listed.where("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"), *kept)
    return listed.where("n > 0").join(out, "digest").select("doc_id", size, "component_id", "class_id", *kept).unionByName(alone)


def classes(docs: DataFrame, join: Join = Join(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs; see classed_rows."""
    return classed_rows(docs, join, text, id_column).select("doc_id", "n_shingles", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; see classed_rows for nulls, ties, repeats and empty tables."""
    return classes(docs)
