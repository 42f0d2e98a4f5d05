"""Names that are nearly alike: a join on rare letter groups, whose pairs are then compared sign by sign."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import named, stored
from . import mentions

#: Particles dropped from the end of a word, and the least likeness of two names.
PARTICLES = ("은", "는", "이", "가", "의", "와", "과", "랑", "이랑", "하고", "를", "에서", "에게", "보다", "이나", "나", "에", "만", "도", "며")
LEAST_PERCENT = 80
#: Strings up to so many signs have their bound tabled; the bound of longer ones is that of this length or more.
TABLED = 256


def kept_grams(size: int, percent: int, q: int = 2) -> int:
    """How many of the size - q + 1 grams of a string are at least in every other string whose likeness is enough.

    With k signs dropped and j added, l = size - k signs are common and 2 l / (size + l + j) is the likeness. Each drop
    costs q grams at most, each addition q - 1.
    """
    least = size
    for k in range(size):
        common = size - k
        j = max(0, (200 * common) // percent - size - common)  # additions that the likeness still allows
        if 200 * common >= percent * (size + common):
            least = min(least, size - q + 1 - q * k - (q - 1) * j)
    return max(0, least)


def shortest_sure(percent: int) -> int:
    """The size from which on every string shares a pair of letters with all that are enough alike."""
    bounds = [kept_grams(n, percent) for n in range(TABLED + 1)]
    return max((n for n in range(TABLED + 1) if bounds[n] < 1), default=0) + 1


def common_signs(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, one whole-number addition for each sign of b."""
    if masks is None:
        masks = sign_masks(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & masks.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def sign_masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def _grams(keys: DataFrame, least: int, percent: int, rare: DataFrame | None = None) -> DataFrame:
    """(key, size, gram): the pairs of letters of each key of at least so many signs, told apart when they repeat.

    With ``rare`` (gram, times) only so many of the rarest that two keys that are alike must share one of them.
    """
    key = F.col("key")
    pairs = F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substring(key, i, F.lit(2)))
    counted = F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda h: h == g)).cast("string")))
    listed = keys.where(F.length(key) >= max(2, least)).select("key", F.length(key).alias("size"), F.explode(counted).alias("gram"))
    if rare is None:
        return listed
    kept = F.array(*[F.lit(kept_grams(n, percent)) for n in range(TABLED + 1)])
    sure = F.element_at(kept, F.least(F.col("size"), F.lit(TABLED)).cast("int") + 1)
    ordered = listed.join(rare, "gram", "left").withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("times", F.lit(0)), "gram")))
    return ordered.where(F.col("_n") <= F.col("size") - sure).select("key", "size", "gram")


def candidate_pairs(values: DataFrame, names: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(value, name): distinct pairs of the tables' keys (column key) that may be alike, all that are among them.

    Strings of some length share rare pairs of letters; shorter ones, and those they can be alike with, share a letter.
    Both sides are dealt by that alone, so no pair is formed that shares nothing.
    """
    sure = shortest_sure(percent)
    longest = (sure - 1) * (200 - percent) // percent  # what a short string can be alike with
    short = lambda keys: keys.where(F.length("key").between(1, longest)).select("key", F.length("key").alias("size"), F.explode(F.array_distinct(F.split("key", ""))).alias("gram"))
    times = stored(_grams(names, sure, percent).groupBy("gram").agg(F.count("*").alias("times")), "fuzzy-grams")
    sides = []
    for keys in (values, names):
        sides.append(_grams(keys, sure, percent, times).unionByName(short(keys).select("key", "size", F.concat(F.lit("1:"), F.col("gram")).alias("gram"))))
    left, right = (s.select(F.col("key").alias(k), F.col("size").alias(f"{k}_size"), "gram") for s, k in zip(sides, ("value", "name"), strict=True))
    near = (F.least("value_size", "name_size") * 200 >= (F.col("value_size") + F.col("name_size")) * percent) & (F.col("gram").startswith("1:") <= (F.least("value_size", "name_size") < sure))
    return left.join(right, "gram").where(near).select("value", "name").distinct()


def similar(values: DataFrame, names: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(value, name, ratio): all distinct pairs of the tables' keys whose likeness is at least ``percent``.

    The likeness is 200 times the longest common subsequence over the sum of the lengths. Null and empty keys are alike
    with nothing; repeated keys count once; empty tables give an empty one.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[str, dict[str, int]] = {}
        for b in batches:
            rows = []
            for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(masks) > 1 << 16:
                    masks.clear()
                if n not in masks:
                    masks[n] = sign_masks(n)
                common = common_signs(n, v, masks[n])
                if 200 * common >= percent * (len(v) + len(n)):
                    rows.append((v, n, 200 * common / (len(v) + len(n))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["value", "name", "ratio"])

    keys = [stored(side.select("key").where("key <> ''").distinct(), "fuzzy-keys") for side in (values, names)]
    return candidate_pairs(*keys, percent).mapInArrow(compare, "value string, name string, ratio double")


def words_of(text: Column, particles: Sequence[str] = PARTICLES) -> Column:
    """The distinct keys of a text's words without their particles, of two signs at least."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[가-힣A-Za-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda w: T.match_key(T.strip_particles(w, particles))), lambda w: F.length(w) >= 2))


def companies_nearly_in(texts: DataFrame, text: str, names: DataFrame, name: str, code: str, key: Sequence[str], percent: int = LEAST_PERCENT) -> DataFrame:
    """(key..., word, name, codes, code, ratio) of texts in which no name stands as it is.

    Each word goes to the name most like it (ties to the smaller name) if that is enough alike; code is null where the
    name stands for several. Words are compared once, however many texts they are in.
    """
    without = texts.join(mentions.companies_in(texts, text, names, name, code, key).select(*key).distinct(), list(key), "left_anti")
    words = without.select(*key, F.explode(words_of(named(text))).alias("word"))
    known = mentions.alias_codes(names, name, code)
    alike = similar(words.select(F.col("word").alias("key")), known.select(F.col("name").alias("key")), percent)
    first = alike.groupBy("value").agg(F.min(F.struct(-F.col("ratio"), "name")).alias("best"), F.max("ratio").alias("ratio")).select("value", "best.name", "ratio")
    return words.join(first, words["word"] == first["value"]).join(known, "name").select(*key, "word", "name", "codes", F.when(F.col("codes") == 1, F.col("code")).alias("code"), "ratio")
