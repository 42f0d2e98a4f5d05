"""Resampling, quality and divergence against plain versions, and their rows for odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from evidra.llm import divergence, quality, resampling
from evidra.llm.common import remainder

from .test_operators import EDGES, by_id, none, odd  # noqa: F401 (fixtures)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_crcs_of_word_runs_are_composed():
    words = resampling.WordCrcs()
    for text in ("the Cat sat, on the mat", "", None, "a", "é日本 x1 Y", "w " * 50, "x" * 3000 + " y"):
        found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        got = [g.tolist() for g in resampling.gram_crcs(*words(text), 1, 4)]
        want = [[zlib.crc32(" ".join(found[i : i + n]).encode()) for i in range(len(found) - n + 1)] for n in range(1, 5)]
        assert got == want[: len(got)] and not any(want[len(got) :])


def brute_resample(docs, target, percent, low, high, buckets, least, seed):
    grams = lambda t: [" ".join(w[i : i + n]) for w in [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in grams(text)) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in docs:
        g = [gain(bucket(x)) for x in grams(text)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text)))))
    may = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    return out, may[: len(may) * percent // 100]


def test_resampling_equals_brute_force(spark, odd, none):  # noqa: F811
    draw = random.Random(7)
    rows = EDGES + [(100 + k, " ".join(draw.choices("alpha beta gamma delta eps zeta".split(), k=draw.randint(0, 40)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS id", "2 AS n_words").repartition(5)
    target = spark.createDataFrame([("alpha beta alpha",), (None,), ("zeta é",)], "text string")
    for low, high in ((1, 1), (1, 3), (2, 2)):
        got = resampling.resample(docs, target, 30, low, high, 500, 12, "s").collect()
        every, drawn = brute_resample(rows, ["alpha beta alpha", None, "zeta é"], 30, low, high, 500, 12, "s")
        assert sorted((r["doc_id"] or -1, r["n_features"], r["weight"], r["score"]) for r in got) == sorted((x[0] or -1, *x[1:4]) for x in every)
        ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
        assert [r["score"] for r in ranked] == [x[3] for x in drawn]
        alone = [k for k, x in enumerate(drawn) if x[0] != 9]  # id 9 is there twice
        assert [ranked[k]["doc_id"] for k in alone] == [drawn[k][0] for k in alone]
    assert resampling.resample(none, target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == len(EDGES)


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(text)))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = [t for t in df if df[t] >= least]
        sources = sorted({d[1] for d in own})
        count = {s: Counter() for s in [*sources, None]}
        for _, s, c in own:
            for t in kept:
                count[s][t] += c[t]
                count[None][t] += c[t]
        share = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept} for s, c in count.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(share[s][t], share[None][t]), t) for t in kept if count[s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def test_divergence_equals_brute_force(spark, odd, none, monkeypatch):  # noqa: F811
    draw = random.Random(3)
    words = [f"{a}{b}" for a in "abcdeé" for b in ("x", "Yz", "日", "q1r")] + ["The", "ﬀ"]
    rows = [(draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", "", None]), " ".join(draw.choices(words, weights=range(1, len(words) + 1), k=draw.randint(0, 30)))) for _ in range(300)]
    rows += [("only", "one", "word word"), ("none", "a", None), ("none", "b", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS n", "'x' AS term", "2 AS p").repartition(6)
    for limits in ({}, {"HELD_CODES": 64, "HELD_RUNS": 16, "AT_ONCE": 32, "STRETCH": 16}):  # also where everything is cut and reduced often
        for name, value in limits.items():
            monkeypatch.setattr(divergence, name, value)
        got = sorted(tuple(r) for r in divergence.audit(docs, 4, 3).collect())
        assert got == brute_divergence(rows, 4, 3)
    assert divergence.audit(none).count() == 0
    found = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.audit(odd, 1).collect()) == brute_divergence(found, 1, 10)


def test_runs_are_the_same_however_often_they_are_reduced(monkeypatch):
    def runs():
        held, out = divergence.Runs(), Counter()
        for k, text in enumerate(["a b a c " * 9, "b b", "", "c d e f g h i j k l " * 4]):
            held.add("en", f"s{k % 2}", text)
        for b in held.emit():
            for r in b.to_pylist():
                assert (r["lang"], r["source"], r["term"]) not in out
                out[r["lang"], r["source"], r["term"]] = (r["docs"], r["n"])
        return out

    want = runs()
    assert want["en", "s0", "a"] == (1, 18) and want["en", "s1", "b"] == (1, 2) and want["en", "s1", ""] == (2, 2)
    monkeypatch.setattr(divergence, "HELD_CODES", 3)
    monkeypatch.setattr(divergence, "STRETCH", 4)
    assert runs() == want


def test_pooled_is_the_best_monotone_fit():
    draw = np.random.default_rng(1)
    for _ in range(50):
        n = draw.integers(0, 4, 12).astype(float)
        hits = np.array([draw.integers(0, int(m) + 1) for m in n], float)
        _, shares = quality.pooled(hits, n)
        fitted = []
        used = np.flatnonzero(n > 0)
        for k in range(len(used)):  # the min-max formula of isotonic regression
            fitted.append(max(min(hits[used[a : b + 1]].sum() / n[used[a : b + 1]].sum() for b in range(k, len(used))) for a in range(k + 1)))
        assert np.allclose(sorted(set(np.round(fitted, 9))), sorted(set(np.round(shares, 9))))
        assert (np.diff(shares) > 0).all()


def test_normal_equations_equal_a_direct_solution(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    stats = quality.measured(docs).cache()
    train = labels.where(remainder("doc_id", 5) != 0)
    model = quality.fit(stats, train)
    x = {r["id"]: np.frombuffer(r["x"], float) for r in stats.collect()}
    rows = {(x[r["doc_id"]].tobytes(), r["quality"]) for r in train.collect() if r["doc_id"] in x}
    a = np.array([np.frombuffer(v, float) for v, _ in rows])
    y = np.array([float(q > 0) for _, q in rows])
    assert np.allclose(model.mean, a.mean(axis=0)) and np.allclose(model.scale[model.scale != 1], a.std(axis=0)[model.scale != 1])
    z = quality.cosines(a, model.mean, model.scale)
    best = np.linalg.lstsq(np.vstack([z, math.sqrt(quality.RIDGE * len(a)) * np.eye(z.shape[1])]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ best, atol=1e-6)
    assert (np.diff(model.shares) >= 0).all() and 0 <= model.shares[0] and model.shares[-1] <= 1


def test_cosines_approximate_the_gaussian_kernel():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(40, quality.SIZE))
    z = quality.cosines(x, np.zeros(quality.SIZE), np.ones(quality.SIZE), 20_000)[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-apart / (2 * quality.WIDTH**2 * quality.SIZE))).max() < 0.05


def test_quality_held_out_and_odd_rows(spark, odd, none, sf_dir):  # noqa: F811
    got = quality.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == (r["quality"] > 0) for r in got) >= 0.9 * len(got)
    stats = quality.measured(odd)
    flat = quality.fit(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(stats, flat).collect()} == {0.5}
    one = quality.fit(stats, spark.createDataFrame([(4, 1), (8, 1), (None, 0), (7, None)], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(stats, one).collect()} == {1.0}
    two = quality.fit(stats, spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0), (8, 1), (9, 0), (9, 1)], "doc_id long, quality int"))
    rows = quality.score(stats, two).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    scores = defaultdict(set)
    texts = dict(EDGES)
    for r in rows:
        scores[texts[r["doc_id"]]].add(r["score"])
    assert all(len(s) == 1 for s in scores.values())
    assert by_id(quality.score(stats, two))[8]["score"] >= by_id(quality.score(stats, two))[4]["score"]
    assert quality.score(quality.measured(none), two).count() == 0 and not quality.statistics(None).any()


def test_statistics_do_not_depend_on_stretches(monkeypatch):
    text = "One two two!! three ### | x\nOne two two!! three ### | x\nLAST line of it"
    want = quality.statistics(text)
    monkeypatch.setattr(quality, "STRETCH", 8)
    got = quality.statistics(text)
    assert np.allclose(got[:21], want[:21])  # the last is the compressed size, of stretches by design
