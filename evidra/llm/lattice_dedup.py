"""Near-duplicate vectors by lattice hashing.

Each table projects vectors at random onto two blocks of eight dimensions and decodes each block to the nearest point
of the E8 lattice; the two points name a cell. A vector lies in its home cell and also probes the cells next nearest
to it. Vectors that meet in a cell are verified by cosine in double precision; those below the threshold never link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_blas_thread, stored
from .graph import components

#: Vectors of a cell that are compared at once with another such block; larger cells are split into block pairs.
BLOCK = 1024


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    rest = x - near
    worst = np.abs(rest).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    step = np.where(rest[rows, worst[rows]] >= 0, 1.0, -1.0)
    near[rows, worst[rows]] += step
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 moved by one half in every coordinate."""
    whole, half = decode_d8(x), decode_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring points."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


@dataclass(frozen=True)
class Lattice:
    """tables and probes: how many tables, and neighbouring cells each vector probes in each; scale: of projections."""

    threshold: float = 0.93
    tables: int = 8
    probes: int = 4
    scale: float = 0.42
    seed: int = 11

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cells (n, tables) and probed cells (n, tables, probes) of unit vectors, as whole numbers."""
        steps = shortest_e8()
        mix = np.random.default_rng(self.seed + 1).integers(1, 1 << 62, 16, dtype=np.int64) | 1
        name = lambda points, t: ((2 * points).astype(np.int64) * mix).sum(axis=-1) * np.int64(0x9E3779B97F4A7C1) + t
        homes, probed = [], []
        for t in range(self.tables):
            x = unit @ np.random.default_rng([self.seed, t, unit.shape[1]]).normal(0, self.scale, (unit.shape[1], 16))
            points = np.concatenate([decode_e8(x[:, :8]), decode_e8(x[:, 8:])], axis=1)
            rest = x - points
            gain = np.concatenate([rest[:, :8] @ steps.T, rest[:, 8:] @ steps.T], axis=1)  # the larger, the nearer
            best = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes]
            moved = np.repeat(points[:, None, :], self.probes, axis=1)
            for k in range(self.probes):
                block, step = np.divmod(best[:, k], len(steps))
                for side in (0, 1):
                    rows = np.flatnonzero(block == side)
                    moved[rows, k, 8 * side : 8 * side + 8] += steps[step[rows]]
            homes.append(name(points, t)), probed.append(name(moved, t))
        return np.stack(homes, axis=1), np.stack(probed, axis=1)


def _name(label: Any, raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(repr(label).encode() + b"\0" + raw, digest_size=8).digest(), "big") >> 1


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, node, vector): node names label and vector together; null where the row links with nothing."""
    for b in batches:
        nodes, vectors = [], []
        for lab, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = np.array(v, np.float64) if v and lab is not None and None not in v else np.zeros(0)
            good = len(x) > 0 and bool(np.isfinite(x).all()) and float(np.abs(x).max()) > 0
            x = x / np.abs(x).max() if good else x  # so that very large or small vectors keep their direction
            nodes.append(_name(lab, x.tobytes()) if good else None), vectors.append(x.tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), b.column(1), pa.array(vectors, pa.binary())], names=["vec_id", "node", "label", "vector"])


def _cells(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, labels = [np.frombuffer(v) for v in b.column(2).to_pylist()], b.column(1).to_pylist()
            homes, probed = [None] * len(vectors), [None] * len(vectors)
            for width in {len(v) for v in vectors}:
                rows = [k for k, v in enumerate(vectors) if len(v) == width]
                x = np.stack([vectors[k] for k in rows])
                h, p = lattice.cells(x / np.linalg.norm(x, axis=1, keepdims=True))
                for k, own, near in zip(rows, h, p, strict=True):
                    salt = np.int64(_name((labels[k], width), b"cell"))
                    homes[k], probed[k] = own ^ salt, (near ^ salt).ravel()
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(homes, longs), pa.array(probed, longs)], names=["node", "homes", "probed"])

    return run


def _compare(lattice: Lattice):
    """Rows sorted by (cell, i, j): link counts of each node, and a forest of links, for each block pair of a cell."""
    tables, probes = lattice.tables, lattice.probes

    def met(a: dict[str, np.ndarray], b: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether a[p] and b[q] meet, by table; a has the smaller node of each pair."""
        same = a["homes"][p] == b["homes"][q]
        return same | (a["probed"][p] == b["homes"][q][:, :, None]).any(axis=2), same | (b["probed"][q] == a["homes"][p][:, :, None]).any(axis=2)

    def cell(rows: list[dict[str, Any]], cell_i: int, cell_j: int) -> Iterator[tuple[int, int, int, int]]:
        part = lambda k: [r for r in rows if r["block"] == k]
        left, right = part(cell_i), part(cell_j)
        if not left or not right:
            return
        table = rows[0]["table"]

        def arrays(own: list[dict[str, Any]]) -> dict[str, np.ndarray]:
            x = np.stack([np.frombuffer(r["vector"]) for r in own])
            return {
                "x": x / np.linalg.norm(x, axis=1, keepdims=True), "node": np.array([r["node"] for r in own]), "weight": np.array([r["weight"] for r in own]), "home": np.array([r["home"] for r in own]),
                "homes": np.array([r["homes"] for r in own]).reshape(-1, tables), "probed": np.array([r["probed"] for r in own]).reshape(-1, tables, probes),
            }

        a = arrays(left)
        b = a if cell_i == cell_j else arrays(right)
        close = a["x"] @ b["x"].T >= lattice.threshold
        close &= (a["home"][:, None] | b["home"][None, :]) & (a["node"][:, None] != b["node"][None, :])
        p, q = np.nonzero(np.triu(close, 1) if a is b else close)
        counts: dict[int, int] = {}
        for s in range(0, len(p), 50_000):
            x, y = p[s : s + 50_000], q[s : s + 50_000]
            low = a["node"][x] < b["node"][y]
            forward, back = met(a, b, x, y)
            by_low, by_high = np.where(low[:, None], forward, back), np.where(low[:, None], back, forward)
            first = (by_low | by_high).argmax(axis=1) == table  # counted in the first table where they meet
            both_home = a["home"][x] & b["home"][y]
            low_home = np.where(low, a["home"][x], b["home"][y])
            # not both at home: the cell of the larger counts, or that of the smaller if only the larger probes
            own = both_home | ~low_home | ~by_low[:, table]
            use = first & own
            for n, w in zip(np.concatenate([a["node"][x[use]], b["node"][y[use]]]).tolist(), np.concatenate([b["weight"][y[use]], a["weight"][x[use]]]).tolist(), strict=True):
                counts[n] = counts.get(n, 0) + w
        for n, w in counts.items():
            yield n, n, w, 0
        roots: dict[int, int] = {}

        def root(n: int) -> int:
            while (up := roots.setdefault(n, n)) != n:
                roots[n] = roots[up]
                n = up
            return n

        for n, m in zip(a["node"][p].tolist(), b["node"][q].tolist(), strict=True):
            r, s = root(n), root(m)
            if r != s:
                roots[max(r, s)] = min(r, s)
                yield n, m, 0, 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        now, held = None, []
        out: list[tuple[int, int, int, int]] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["a", "b", "n", "kind"])

        for b in batches:
            for row in b.to_pylist():
                key = row["cell"], row["i"], row["j"]
                if key != now:
                    if held:
                        out.extend(cell(held, now[1], now[2]))
                    now, held = key, []
                held.append(row)
            if len(out) > 10_000:
                yield batch()
        if held:
            out.extend(cell(held, now[1], now[2]))
        yield batch()

    return run


def link(vectors: DataFrame, lattice: Lattice = Lattice()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors (vec_id, embedding, label).

    Only equal, non-null labels and equal lengths are compared. Null, zero and non-finite vectors, and those with null
    components, are alone. Equal vectors of a label are one node with a weight. Cells of any size are compared whole,
    in block pairs. Cells with one vector are dropped before vectors are moved.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    kind = vectors.schema["label"].dataType.simpleString()
    listed = stored(source.mapInArrow(_nodes, f"vec_id long, node long, label {kind}, vector binary"), "lattice-rows")
    nodes = listed.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = stored(nodes, "lattice-nodes")
    placed = stored(nodes.select("node", "label", "vector").mapInArrow(_cells(lattice), "node long, homes array<long>, probed array<long>"), "lattice-cells")
    home = placed.select("node", F.posexplode("homes").alias("table", "cell")).withColumn("home", F.lit(True))
    probe = placed.select("node", F.posexplode("probed").alias("table", "cell")).withColumn("table", F.floor(F.col("table") / lattice.probes).cast("int")).withColumn("home", F.lit(False))
    entries = home.unionByName(probe)
    sizes = entries.groupBy("cell").agg(F.count("*").alias("size"), F.max("home").alias("lived")).where("size > 1 AND lived").select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    live = entries.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    split = live.select("*", other).select("node", "table", "cell", "home", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    whole = split.join(placed, "node").join(nodes.select("node", "vector", "weight"), "node")
    found = whole.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node").select("cell", "i", "j", "block", "table", "node", "home", "vector", "weight", "homes", "probed")
    pairs = stored(found.mapInArrow(_compare(lattice), "a long, b long, n long, kind int"), "lattice-links")
    counts = pairs.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(pairs.where("kind = 1").select("a", "b"))
    named = nodes.join(labels, "node", "left").join(counts, "node", "left").select("node", "least", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classed = named.join(smallest, "component").select("node", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    out = listed.join(classed, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(vectors: DataFrame) -> DataFrame:
    return link(vectors)
