"""Names in texts: every place of every name, by one automaton that walks many stretches of text at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import free_name, named, stored

#: Signs of the names that one automaton holds; more names take more automata, each of which meets the texts.
PART_SIGNS = 1 << 20
#: Stretches that walk in step, signs of a stretch at least, and signs walked at once.
LANES, LEAST_STRETCH, AT_ONCE = 4096, 256, 1 << 22


@cache
def fold_table() -> np.ndarray:
    """For each code point of the first plane its lower-case form if that is a digit, a Latin or a Hangul letter, else 0."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()[:1]
            if "0" <= low <= "9" or "a" <= low <= "z" or "가" <= low <= "힣":
                out[c] = ord(low)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """Goto, failure and output functions of a set of distinct names, as flat arrays.

    The goto function is a double array: the slot base[state] + sign belongs to the state that check names, and target is
    where it leads. States are numbered by depth, so failures and outputs are found depth by depth for all states at once.
    """

    def __init__(self, names: Sequence[str]) -> None:
        self.sizes = np.fromiter(map(len, names), np.int64, len(names))
        codes = code_points("".join(names))
        self.alphabet = np.unique(codes)
        signs = np.searchsorted(self.alphabet, codes) + 1
        self.longest = int(self.sizes.max(initial=1))
        table = np.zeros((len(names), self.longest), np.int32)
        table[np.arange(self.longest)[None, :] < self.sizes[:, None]] = signs
        order = np.lexsort(table.T[::-1])
        table, sizes = table[order], self.sizes[order]
        differ = table[1:] != table[:-1]
        shared = np.concatenate([[-1], np.where(differ.any(axis=1), differ.argmax(axis=1), self.longest)])
        node, count = np.zeros(len(names), np.int64), 1
        parents, edge_signs, depths, words = [], [], [], [-1]
        for depth in range(1, self.longest + 1):
            there = sizes >= depth
            first = there & ((shared < depth) | ~np.concatenate([[False], there[:-1]]))
            rows = np.flatnonzero(first)
            parents.append(node[rows]), edge_signs.append(table[rows, depth - 1]), depths.append(len(rows))
            node = np.where(there, count - 1 + np.cumsum(first), node)
            count += len(rows)
            word = np.full(len(rows), -1)
            ends = np.flatnonzero(sizes == depth)
            word[node[ends] - (count - len(rows))] = order[ends]
            words.extend(word.tolist())
        self.word = np.array(words, np.int32)
        parent, sign = np.concatenate(parents or [[]]).astype(np.int64), np.concatenate(edge_signs or [[]]).astype(np.int64)
        self._place(parent, sign, count)
        self._link(parent, sign, depths, count)

    def _place(self, parent: np.ndarray, sign: np.ndarray, states: int) -> None:
        """Gives every state a base at which the slots of its signs are free.

        States with several signs are placed from where the last of them was, so the search only moves on; those with
        one sign fill the lowest slot that is free.
        """
        width = len(self.alphabet) + 1
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, int)
        ends = np.append(starts[1:], len(parent))
        taken = bytearray(len(parent) + 2 * width + 1)
        base, slots = np.zeros(states, np.int64), np.zeros(len(parent), np.int64)
        ordered = np.argsort(starts - ends, kind="stable")  # most signs first, so that single ones find the holes
        listed, last, free, many = sign.tolist(), width, width, width
        for k in ordered.tolist():
            a, b = int(starts[k]), int(ends[k])
            wanted = listed[a:b]
            if b - a == 1:
                free = taken.find(0, free)
                at = free - wanted[0]
            else:
                at = many
                while any(taken[at + s] for s in wanted):
                    at += 1
                many = at
            for s in wanted:
                taken[at + s] = 1
            last = max(last, at + width)
            if last + 2 * width >= len(taken):
                taken.extend(bytes(len(taken)))
            slots[a:b] = np.array(wanted) + at
            base[parent[a]] = at
        size = last + width + 1
        self.base, self.check, self.target = base, np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.check[slots], self.target[slots] = parent, np.arange(1, len(parent) + 1)

    def _link(self, parent: np.ndarray, sign: np.ndarray, depths: Sequence[int], states: int) -> None:
        self.fail, self.next_word = np.zeros(states, np.int32), np.zeros(states, np.int32)
        at = 1
        for depth, n in enumerate(depths):
            own = slice(at, at + n)
            if depth:
                self.fail[own] = self.step(self.fail[parent[at - 1 : at - 1 + n]], sign[at - 1 : at - 1 + n])
            ends = self.fail[own]
            self.next_word[own] = np.where(self.word[ends] >= 0, ends, self.next_word[ends])
            at += n
        self.speaks = (self.word >= 0) | (self.next_word > 0)

    def step(self, states: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """The states after one sign each; sign 0 leads to the root."""
        out = np.zeros(len(states), np.int32)
        at = np.flatnonzero(signs)
        s, c = states[at], signs[at]
        while len(at):
            slot = self.base[s] + c
            hit = self.check[slot] == s
            out[at[hit]] = self.target[slot[hit]]
            on = ~hit & (s != 0)
            at, s, c = at[on], self.fail[s[on]], c[on]
        return out

    def signs(self, codes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.alphabet, codes)
        place[place == len(self.alphabet)] = 0
        return np.where(self.alphabet[place] == codes, place + 1, 0)

    def find(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last place, name) of every occurrence in a stream of signs.

        The stream is cut into stretches that walk in step; each starts so far before its own part that it has forgotten
        nothing when that begins.
        """
        n, warm = len(stream), self.longest - 1
        lanes = max(1, min(LANES, n // max(LEAST_STRETCH, 2 * warm)))
        own = -(-n // lanes)
        starts = np.arange(lanes) * own
        state = np.zeros(lanes, np.int32)
        places, states = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k in range(-warm, own):
            at = starts + k
            there = (at >= 0) & (at < n)
            state = self.step(state, np.where(there, stream[np.clip(at, 0, n - 1)], 0))
            if k >= 0:
                speaks = self.speaks[state]
                if speaks.any():
                    places.append(at[speaks]), states.append(state[speaks])
        place, at_state = np.concatenate(places), np.concatenate(states)
        found, names = [], []
        while len(place):
            word = self.word[at_state]
            found.append(place[word >= 0]), names.append(word[word >= 0])
            at_state = self.next_word[at_state]
            place, at_state = place[at_state > 0], at_state[at_state > 0]
        empty = np.zeros(0, np.int64)
        return np.concatenate(found or [empty]), np.concatenate(names or [empty])


def _streams(texts: Sequence[str | None], folded: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts as (code points of the kept signs, their text or -1 between texts, their place)."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held, gap = 0, (np.zeros(1, np.uint32), np.full(1, -1), np.zeros(1, np.int64))
    for k, text in enumerate(texts):
        codes = code_points(text or "")
        if folded:
            codes = np.where(codes < 1 << 16, fold_table()[np.minimum(codes, 0xFFFF)], 0).astype(np.uint32)
        at = np.flatnonzero(codes)
        parts += [(codes[at], np.full(len(at), k), at), gap]
        held += len(at)
        if held >= AT_ONCE or k == len(texts) - 1:
            yield tuple(np.concatenate([p[x] for p in parts]) for x in range(3))
            parts, held = [], 0


def _parts(keys: DataFrame) -> Iterator[list[str]]:
    """The distinct keys in lists of bounded size, each key in one of them by its hash."""
    keys = stored(keys.where("name <> ''").distinct(), "names")
    n = int(keys.agg(F.sum(F.length("name"))).first()[0] or 0)
    parts = -(-n // PART_SIGNS)
    for k in range(parts):
        if part := [r[0] for r in keys.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == k).collect()]:
            yield part


def occurrences(texts: DataFrame, text: str, names: DataFrame, name: str, keep: Sequence[str] = (), folded: bool = True, least: int = 2) -> DataFrame:
    """(keep..., name, start, end): every place of every name's key in every text, also nested and overlapping ones.

    With ``folded`` texts and names are compared by their match keys (lower case, only digits, Latin and Hangul letters),
    else sign by sign. start and end are places in the text itself, end exclusive. Keys shorter than ``least`` never
    match; null names and texts have no place; rows that repeat are each searched. Names are dealt into automata of a
    bounded size, which are broadcast, and each walks all texts; no pair of text and name is formed that does not match.
    """
    spark = texts.sparkSession
    key = T.match_key(named(name)) if folded else F.coalesce(named(name), F.lit(""))
    keys = names.select(key.alias("name")).where(F.length("name") >= least)
    kept = texts.select(*[named(c) for c in keep], named(text).alias(free_name("text", texts)))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]], "name string, start long, end long"])

    def search(words: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast((Automaton(words), words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, listed = sent.value
            listed = pa.array(listed, pa.string())
            for b in batches:
                for codes, owner, place in _streams(b.column(b.num_columns - 1).to_pylist(), folded):
                    last, word = automaton.find(automaton.signs(codes))
                    first = last - automaton.sizes[word] + 1
                    rows = pa.array(owner[last])
                    columns = [c.take(rows) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*columns, listed.take(pa.array(word)), pa.array(place[first]), pa.array(place[last] + 1)], names=[*b.schema.names[:-1], "name", "start", "end"])

        return kept.mapInArrow(run, schema)

    found: DataFrame | None = None
    for words in _parts(keys):
        found = search(words) if found is None else found.unionByName(search(words))
    return spark.createDataFrame([], schema) if found is None else found


def alias_codes(names: DataFrame, name: str, code: str) -> DataFrame:
    """(name, codes, code): the match key of each name, how many codes it stands for, and the smallest."""
    keyed = names.select(T.match_key(named(name)).alias("name"), named(code).alias("code")).where("name <> '' AND code IS NOT NULL")
    return keyed.groupBy("name").agg(F.count_distinct("code").alias("codes"), F.min("code").alias("code"))


def companies_in(texts: DataFrame, text: str, names: DataFrame, name: str, code: str, key: Sequence[str]) -> DataFrame:
    """(key..., name, codes, code, place): what a text names.

    Where some name stands for several codes, those names alone, for the asker to choose (code is null). Else each code
    once, by its longest name there. place counts from 1, longest names first, ties by the name's bytes. ``key`` tells
    texts apart.
    """
    there = occurrences(texts, text, names, name, key).select(*key, "name").distinct()
    known = there.join(alias_codes(names, name, code), "name")
    own = Window.partitionBy(*key)
    longest = [F.desc(F.length("name")), F.asc("name")]
    split = known.withColumn("_unclear", F.max((F.col("codes") > 1).cast("int")).over(own)).where((F.col("_unclear") == 0) | (F.col("codes") > 1))
    once = split.withColumn("_n", F.when(F.col("codes") > 1, 1).otherwise(F.row_number().over(Window.partitionBy(*key, "code", F.col("codes") > 1).orderBy(*longest)))).where("_n = 1")
    return once.select(*key, "name", "codes", F.when(F.col("codes") == 1, F.col("code")).alias("code"), F.row_number().over(own.orderBy(*longest)).alias("place"))


def ambiguity_groups(names: DataFrame, name: str, code: str) -> DataFrame:
    """(name, code): all codes of each key that stands for several."""
    keyed = names.select(T.match_key(named(name)).alias("name"), named(code).alias("code")).where("name <> '' AND code IS NOT NULL").distinct()
    return keyed.join(alias_codes(names, name, code).where("codes > 1").select("name"), "name", "left_semi")


def contained(needles: DataFrame, needle: Column, hay: DataFrame, value: str, least: int = 2) -> DataFrame:
    """(needle, value): distinct pairs where the value contains the needle, sign by sign."""
    found = occurrences(hay.select(named(value).alias("value")).distinct(), "value", needles.select(needle.alias("needle")).distinct(), "needle", ["value"], folded=False, least=least)
    return found.select(F.col("name").alias("needle"), "value").distinct()
