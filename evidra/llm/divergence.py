"""Source divergence audit by sorted runs: which sources of a language differ most, and by which terms.

Tasks cut texts into terms, sort their (term, source, document) codes and reduce each run to (documents, count) before
anything is shuffled. The partial runs meet by (lang, term), sorted by (lang, term, source, document), and one streaming
pass reduces them: the documents of a run decide whether the term is kept. A second pass over the kept runs, sorted
alike, emits partial pair sums of the sources that share a term, and the best terms of each source.

A pair's sum runs over all kept terms, also those that one or both sources lack. With p0 the value of an absent term,
sum f(p, q) = V f(p0, q0) + sum over the terms of one source of f(p, q0) - f(p0, q0), the same for the other, and for
the terms of both f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). Only the last needs the pairs of a run; the second needs no
more than how often each value of p occurs. All of it is integer arithmetic, so nothing is approximated.
"""

from __future__ import annotations

import functools
import operator
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, forget, small_batches, stored

#: Lowers A-Z and turns every byte that is no letter and not part of a character beyond ASCII into a space.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in ASCII_LOWER)
SCALE_ROUNDS, SCALE_STEP = 3, 1000  # a share is counted in billionths, found in three rounds of thousandths
#: Codes held before they are reduced, runs held before they are sent on, rows taken from the sorted stream at once.
HELD_CODES, HELD_RUNS, AT_ONCE = 1 << 21, 1 << 20, 1 << 16
#: Bytes of a text that are cut into terms at once.
STRETCH = 1 << 22
#: Parts that the sources of a language are dealt into when they are paired.
PAIR_PARTS = 32


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8, in lists of one stretch each."""
    data, at = text.encode().translate(TERM_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def reduce_runs(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return (keys[first], *[np.add.reduceat(v[order], first) if len(first) else v for v in values])


class Runs:
    """Runs of (term, group) of one task, each with its documents and its count, in bounded memory."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.groups: dict[tuple[str, str], int] = defaultdict()
        self.groups.default_factory = self.groups.__len__
        self.documents = 0
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.runs = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, lang: str, source: str, text: str) -> None:
        """Codes of 26 bits for the term, 17 for the group and 20 for the document, to be sorted as one number."""
        low = self.groups[lang, source] << 20 | self.documents
        self.documents += 1
        self.pending.append(np.array([self.codes[b""] << 37 | low], np.int64))  # the group occurs, with or without terms
        for found in terms(text):
            ids = np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found))
            if len(self.codes) > 1 << 26:
                raise ValueError("a text holds more than 2^26 distinct terms")
            self.pending.append(ids << 37 | low)
            self.held += len(found)
            if self.held >= HELD_CODES:
                self.reduce(whole=False)

    def reduce(self, whole: bool = True) -> None:
        """Sorts what is pending; each run of equal codes is one document of its (term, group).

        In the middle of a text the last document stays pending, one code for each of its terms, with the count apart.
        """
        if not self.pending:
            return
        keys = np.sort(np.concatenate(self.pending))
        last = None if whole else self.documents - 1
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        documents = np.ones(len(keys), np.int64)
        self.pending, self.held = [], 0
        if last is not None:
            open_ = (keys & ((1 << 20) - 1)) == last
            documents[open_] = 0  # counted once, when the text ends
            self.pending, self.held = [keys[open_]], int(open_.sum())
            counts[open_] -= 1  # its remaining code counts later
        own = reduce_runs(keys >> 20, documents, counts)
        self.runs = reduce_runs(*[np.concatenate(pair) for pair in zip(self.runs, own, strict=True)])

    @property
    def full(self) -> bool:
        return len(self.runs[0]) >= HELD_RUNS or self.documents >= 1 << 20 or len(self.groups) >= 1 << 17 or len(self.codes) >= 1 << 21

    def emit(self) -> Iterator[pa.RecordBatch]:
        self.reduce()
        names = pa.array(list(self.codes), pa.binary()).cast(pa.string())
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for at in range(0, len(self.runs[0]), AT_ONCE):
            keys, documents, counts = (v[at : at + AT_ONCE] for v in self.runs)
            group = pa.array(keys & ((1 << 17) - 1))
            yield pa.RecordBatch.from_arrays([langs.take(group), names.take(pa.array(keys >> 17)), sources.take(group), pa.array(documents), pa.array(counts)], names=["lang", "term", "source", "docs", "n"])
        self.clear()


def partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = Runs()
    for b in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
            runs.add(lang, source, text)
            if runs.held >= HELD_CODES:
                runs.reduce()
            if runs.full:
                yield from runs.emit()
    yield from runs.emit()


def _starts(t: pa.Table, names: list[str]) -> np.ndarray:
    """Where rows begin that differ from the row before in any of the named columns."""
    n = t.num_rows
    differ = [pc.not_equal(t[c].slice(1), t[c].slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in names]
    return np.flatnonzero(np.concatenate([[True], functools.reduce(operator.or_, differ)])) if n else np.zeros(0, int)


def _whole_runs(batches: Iterator[pa.RecordBatch], shorten: Callable[[pa.Table], pa.Table] = lambda t: t) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The sorted stream in tables that hold whole runs of (lang, term), with their starts; shorten reduces what is held."""
    held: list[pa.Table] = []
    rows = 0

    def taken(last: bool) -> tuple[pa.Table, np.ndarray] | None:
        nonlocal held, rows
        t = shorten(pa.concat_tables(held).combine_chunks())
        starts = _starts(t, ["lang", "term"])
        cut = t.num_rows if last else int(starts[-1])
        held, rows = ([] if last else [t.slice(cut)]), 0
        return (t.slice(0, cut), starts if last else starts[:-1]) if cut else None

    for b in batches:
        if b.num_rows:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
        if rows >= AT_ONCE and (got := taken(False)):
            yield got
    if held and (got := taken(True)):
        yield got


def _by_source(t: pa.Table) -> pa.Table:
    """One row for each (lang, term, source) of a sorted table."""
    first = _starts(t, ["lang", "term", "source"])
    sums = {c: np.add.reduceat(t[c].to_numpy(), first) for c in ("docs", "n")} if len(first) else {c: t[c].to_numpy() for c in ("docs", "n")}
    return pa.table({**{c: t[c].take(pa.array(first)) for c in ("lang", "term", "source")}, **{c: pa.array(v) for c, v in sums.items()}})


def kept_runs(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scan of partial runs: every source of the terms in enough documents, with the term's total; and all groups (term '')."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_runs(batches, _by_source):
            sizes = np.diff(np.append(starts, t.num_rows))
            documents, totals = (np.add.reduceat(t[c].to_numpy(), starts) for c in ("docs", "n"))
            keep = np.repeat(documents >= least, sizes) | pc.equal(t["term"], "").to_numpy()
            out = t.drop_columns(["docs"]).append_column("total", pa.array(np.repeat(totals, sizes))).filter(pa.array(keep))
            yield from out.combine_chunks().to_batches()

    return scan


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Best:
    """The largest values of each group, ties to the smaller item, in bounded memory."""

    def __init__(self, top: int) -> None:
        self.top, self.rows = top, defaultdict(list)

    def add(self, group: tuple[str, str], value: int, item: bytes) -> None:
        rows = self.rows[group]
        rows.append((-value, item))
        if len(rows) >= 8 * self.top + 64:
            rows.sort()
            del rows[self.top :]

    def emit(self) -> Iterator[tuple[str, str, str, int]]:
        for (lang, source), rows in self.rows.items():
            for value, item in sorted(rows)[: self.top]:
                yield lang, source, item.decode(), -value
        self.rows.clear()


def pair_and_term_runs(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scan of kept runs with p, p0 and q: partial sums of the pairs that share a term, and the task's best terms of each group."""

    def rows(part: str, columns: list[list]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["part", "lang", "source", "item", "value"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = defaultdict()
        groups.default_factory = groups.__len__
        best = Best(top)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            return reduce_runs(*[np.concatenate([x[k] for x in pending]) for k in (0, 1)]) if pending else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def pairs() -> Iterator[pa.RecordBatch]:
            nonlocal pending, size
            keys, sums = reduced()
            pending, size = [], 0
            names = list(groups)
            for at in range(0, len(keys), AT_ONCE):
                ends = [(names[k >> 31], names[k & ((1 << 31) - 1)], s) for k, s in zip(keys[at : at + AT_ONCE].tolist(), sums[at : at + AT_ONCE].tolist(), strict=True)]
                ends = [(a, b, s) if a[1] < b[1] else (b, a, s) for a, b, s in ends]
                yield rows("pair", [[a[0] for a, _, _ in ends], [a[1] for a, _, _ in ends], [b[1] for _, b, _ in ends], [s for _, _, s in ends]])

        for t, starts in _whole_runs(batches):
            ends = np.append(starts[1:], t.num_rows)
            p, p0, q = (t[c].to_numpy() for c in ("p", "p0", "q"))
            code = np.fromiter((groups[x] for x in zip(t["lang"].to_pylist(), t["source"].to_pylist(), strict=True)), np.int64, t.num_rows)
            more = np.flatnonzero(p > q)
            items = pc.take(t["term"], pa.array(more)).cast(pa.binary()).to_pylist()
            names = list(groups)
            for k, value, item in zip(code[more].tolist(), divergence(p[more], q[more]).tolist(), items, strict=True):
                best.add(names[k], value, item)
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                block = max(1, AT_ONCE // (b - a))
                for i in range(a, b - 1, block):  # a run of many sources is paired block by block
                    stop = min(i + block, b)
                    gi, hi = (x.ravel() for x in np.broadcast_arrays(np.arange(i, stop)[:, None], np.arange(i, b)[None, :]))
                    gi, hi = gi[gi < hi], hi[gi < hi]
                    value = divergence(p[gi], p[hi]) - divergence(p[gi], p0[hi]) - divergence(p0[gi], p[hi]) + divergence(p0[gi], p0[hi])
                    pending.append((np.minimum(code[gi], code[hi]) << 31 | np.maximum(code[gi], code[hi]), value))
                    size += len(gi)
                    if size >= HELD_CODES:
                        pending = [reduced()]
                        size = len(pending[0][0])
                        if size >= HELD_RUNS:
                            yield from pairs()
        yield from pairs()
        found = list(best.emit())
        for at in range(0, len(found), AT_ONCE):
            yield rows("term", [list(c) for c in zip(*found[at : at + AT_ONCE], strict=True)])

    return scan


def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 2) / size) without a product that could pass 64 bits."""
    rest, whole = count + 2, F.lit(0).cast("long")
    for _ in range(SCALE_ROUNDS):
        whole, rest = whole * SCALE_STEP + F.call_function("div", rest * SCALE_STEP, size), (rest * SCALE_STEP) % size
    return whole + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs with text, lang and source.

    Part ``pair``: for each (lang, source) every other source of the lang. Part ``term``: its ``top`` terms that are more
    frequent there than in the lang. Ranks from 1 by value descending, then item ascending by its bytes.

    Every row is one document, also where rows repeat an id or a text; null texts, langs and sources count as empty
    texts. A group without terms has its pairs; a lang without kept terms has pairs of value 0; a lang of one source has
    none. An empty table gives an empty one. Texts of any length are cut by stretches. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = filled.mapInArrow(partial_runs, "lang string, term string, source string, docs long, n long")
    runs = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = stored(runs.mapInArrow(kept_runs(least), "lang string, term string, source string, n long, total long"), "divergence-kept")

    found = kept.where("term <> ''")
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = found.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    groups = kept.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    filled_groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).cast("long").alias("v"), (F.coalesce("size", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).cast("long").alias("size"), (F.col("lang_size") + 2 * F.col("v")).cast("long").alias("lang_size"))
    groups = stored(filled_groups.select("*", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("size"))).alias("p0")), "divergence-groups")

    shares = found.join(groups, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("size")).alias("p"), "p0", share(F.col("total"), F.col("lang_size")).alias("q"))
    again = shares.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    emitted = stored(again.mapInArrow(pair_and_term_runs(top), "part string, lang string, source string, item string, value long"), "divergence-runs")

    by_value = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("values"))
    sided = stored(groups.select("lang", "source", "v", "p0").join(by_value, ["lang", "source"], "left"), "divergence-values")
    forget(kept)
    left = sided.withColumn("deal", F.pmod(F.xxhash64("source"), F.lit(PAIR_PARTS)))
    right = sided.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_PARTS - 1).cast("long"))).alias("deal"))
    # Every pair of a lang's sources is a row of the result; dealing the sources keeps one lang from landing in one task.
    each = left.join(right, ["lang", "deal"]).where("source <> item")
    none = _apart(F.col("p0"), F.col("q0"))
    own = F.aggregate(F.coalesce("values", F.array().cast("array<struct<p:bigint,times:bigint>>")), F.lit(0).cast("long"), lambda acc, x: acc + x["times"] * (_apart(x["p"], F.col("q0")) - none))
    half = each.select("lang", "source", "item", F.when(F.col("v") > 0, own).otherwise(0).alias("own"), F.when(F.col("v") > 0, F.col("v") * none).otherwise(0).alias("base"))
    ordered = (F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"))
    both = half.select("lang", *ordered, "own", F.when(F.col("source") < F.col("item"), F.col("base")).otherwise(0).alias("base"))
    common = emitted.where("part = 'pair'").select("lang", F.col("source").alias("a"), F.col("item").alias("b"), F.col("value").alias("own"), F.lit(0).cast("long").alias("base"))
    sums = both.unionByName(common).groupBy("lang", "a", "b").agg((F.sum("own") + F.sum("base")).alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_ends")
    pairs = sums.select("lang", "value", ends).select("lang", "_ends.source", F.lit("pair").alias("part"), "_ends.item", "value")
    listed = pairs.unionByName(emitted.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return listed.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def query(docs: DataFrame) -> DataFrame:
    """Every row of docs, terms in at least 10 documents of their lang, 10 terms a group; see :func:`audit` for odd rows."""
    return audit(docs, least=10, top=10)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
met AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
counts AS (SELECT lang, term, source, count(*) AS n, count(DISTINCT row) AS docs FROM met GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS total FROM counts GROUP BY ALL HAVING sum(docs) >= 10),
langs AS (SELECT lang, count(*)::BIGINT AS v, sum(total)::BIGINT AS size FROM kept GROUP BY ALL),
grouped AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0)::BIGINT AS n FROM grouped g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sizes AS (SELECT lang, source, sum(n)::BIGINT AS size FROM cells GROUP BY ALL),
shares AS (SELECT c.lang, c.source, c.term, c.n, 1 + ((1000000000::HUGEINT * (c.n + 2)) // (s.size + 2 * l.v))::BIGINT AS p,
    1 + ((1000000000::HUGEINT * (c.total + 2)) // (l.size + 2 * l.v))::BIGINT AS q
  FROM cells c JOIN sizes s ON s.lang = c.lang AND s.source = c.source JOIN langs l ON l.lang = c.lang),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
listed AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM listed)
SELECT lang, source, part, item, value, rank::INT AS rank FROM placed WHERE part = 'pair' OR rank <= 10
"""
