"""Interval joins and the positional index against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import comparisons, intervals, numbering, term_index


def test_cover_is_the_interval(spark):
    draw = random.Random(3)
    rows = [(a, a + draw.choice([-1, 0, 1, 7, 63, 64, 500, 3000])) for a in (draw.randint(-5000, 5000) for _ in range(60))] + [(None, 3), (3, None)]
    for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", intervals.cover(F.col("a"), F.col("b")).alias("c")).collect():
        held = sorted(x for p in r["c"] for x in range(p["bucket"] << 3 * p["level"], p["bucket"] + 1 << 3 * p["level"]))
        assert held == (list(range(r["a"], r["b"] + 1)) if None not in (r["a"], r["b"]) else []) and len(r["c"]) <= 14 * 5


def test_points_meet_their_intervals_without_comparing_all(spark):
    draw = random.Random(1)
    points = [(k, draw.choice(["x", "y", None]), draw.choice([None, *range(20_200_101, 20_201_231, 7)])) for k in range(400)]
    asked = [(k, draw.choice(["x", "y", None]), low, low + draw.choice([0, 30, 900, -1])) for k in range(60) for low in [draw.randint(20_200_101, 20_201_231)]] + [(99, "x", -(10**17), 10**17), (99, "x", -(10**17), 10**17), (98, "y", None, 5)]
    a, b = spark.createDataFrame(points, "p long, key string, at long"), spark.createDataFrame(asked, "q long, key string, low long, high long")
    joined = intervals.points_in(a, "at", b, "low", "high", ["key"])
    assert sorted((r["p"], r["q"]) for r in joined.collect()) == sorted((p, q) for p, k, at in points for q, k2, low, high in asked if at is not None and low is not None and k == k2 and k is not None and low <= at <= high)
    assert sorted((r["p"], r["q"]) for r in intervals.points_in(a.drop("key"), "at", b.drop("key"), "low", "high").collect()) == sorted((p, q) for p, _, at in points for q, _, low, high in asked if at is not None and low is not None and low <= at <= high)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    assert intervals.points_in(a, "at", b.limit(0), "low", "high", ["key"]).count() == 0


def test_intervals_are_summed_up_without_their_pairs(spark):
    draw = random.Random(2)
    points = [(draw.choice(["x", "y", None]), draw.choice(["o", "f", None]), draw.choice([None, *range(-40, 900, 7)])) for _ in range(500)]
    asked = [(draw.choice([k, None]), draw.choice(["x", "y", None]), low, low + draw.choice([0, 30, 500, -1])) for k in range(60) for low in [draw.randint(-50, 900)]] + [(99, "x", -(10**17), 10**17), (99, "x", -(10**17), 10**17), (98, "y", None, 5)]
    a, b = spark.createDataFrame(points, "key string, status string, at long"), spark.createDataFrame(asked, "q long, key string, low long, high long")
    for keys in (["key"], []):
        met = {}
        for q, k, low, high in asked:
            for k2, status, at in points:
                if at is not None and low is not None and low <= at <= high and (not keys or k == k2 is not None):
                    met.setdefault((q, status), []).append(at)
        got = intervals.counts_in(a, "at", b, ["q"], "low", "high", ["status"], keys).collect()
        assert {(r["q"], r["status"]): (r["points"], r["first"], r["last"]) for r in got} == {x: (len(v), min(v), max(v)) for x, v in met.items()} and len(got) == len(met)
    assert intervals.counts_in(a, "at", b.limit(0), ["q"], "low", "high").count() == 0


def test_requests_for_all_documents_cost_no_pairs(spark, tmp_path, monkeypatch):
    """2,000 customers with 10 orders of one day each ask for all 20,000 of them: 40 million pairs, 2,000 rows."""
    from evidra.plans import lookups

    o = spark.range(20_000).select((F.col("id") % 2000 * 97).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.to_timestamp(F.lit("1995-01-01")).alias("o_orderdate"))
    o.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(intervals, "points_in", None)  # a row for each pair
    got = lookups.interval_documents(spark, str(tmp_path)).groupBy("documents", "first", "last").count().collect()
    assert [tuple(r) for r in got] == [(20_000, 19_950_101, 19_950_101, 2000)]


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(k * 37 % 100, "x") for k in range(100)], "k long, row_id string").repartition(7)
    got = numbering.numbered(rows, [F.desc("k")], "row_id", 5)
    assert sorted((r["row_id"], r["k"]) for r in got.collect()) == [(5 + n, 99 - n) for n in range(100)]
    assert numbering.numbered(rows.limit(0), ["k"], "n").count() == 0


def test_numbers_are_packed_and_back():
    draw = np.random.default_rng(0)
    values = np.concatenate([[0, 127, 128, 2**62], draw.integers(0, 2**40, 500), draw.integers(0, 300, 500)])
    starts = np.array([0, 4, 5, 900])
    parts = term_index.packed(values, starts)
    assert [term_index.unpacked(p).tolist() for p in parts] == [values[a:b].tolist() for a, b in zip(starts, [*starts[1:], len(values)], strict=True)]
    assert term_index.packed(np.zeros(0)) == [b""] and len(term_index.unpacked(b"")) == 0


def test_lookups_equal_plain_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(term_index, "RANGE_BITS", 3)
    draw = random.Random(9)
    words = ["In", "the", "inner", "thing", "ring", "삼성전자", "é", "net", "x1"]
    rows = [(k, "".join(draw.choice(words) + draw.choice([" ", ", ", "-", "_", "  "]) for _ in range(draw.randint(0, 12)))) for k in range(150)] + [(500, None), (501, ""), (502, "%% !!"), (None, "the ring")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'t' AS term", "1 AS doc").repartition(4)
    index = term_index.build_terms(docs, str(tmp_path / "terms"))
    terms = ["the", "in", "ing ri", "ring, the", "전자", "e_n", "!", "%%", "inner thing ring", "absent", "É", "x1-x1"]
    for limit in (1000, 1):
        monkeypatch.setattr(term_index, "NAMED_WORDS", limit)
        got = sorted((r["no"], r["doc"]) for r in term_index.holding(index, docs, terms).collect())
        assert got == sorted((no, k) for no, t in enumerate(terms) for k, text in rows if k is not None and text and t.lower() in text.lower())
    both = term_index.inspect(index, docs, ["the", "net"], "doc_id", "text", F.col("doc_id") % 2, F.col("doc_id") % 3, 2, together=True).collect()
    for r in both:
        held = [k for k, text in rows if k is not None and text and "the" in text.lower() and "net" in text.lower() and k % 2 == r["year"]]
        assert (r["chunks"], r["documents"], r["docs"]) == (len(held), len({k % 3 for k in held}), sorted(held)[:2]) and r["term"] == "the + net"


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_rows_in_a_row_do_not_depend_on_blocks(spark, block):
    draw = random.Random(2)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([None, *range(9)]), k) for k in range(60)]
    got = comparisons.in_a_row(spark.createDataFrame(rows, "key string, at int, id int").selectExpr("*", "'x' AS block", "1 AS row").repartition(5), ["key"], [F.col("at"), F.col("id")], 3, block)
    want = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want += [[r[2] for r in own[k : k + 3]] for k in range(len(own) - 2)]
    assert sorted([r["id"] for r in x["rows"]] for x in got.collect()) == sorted(want)


def test_groups_by_kind(spark):
    rows = [(1, "r", "2020-01-01", 1, None), (1, "r", "2020-01-01", 2, "c"), (2, "r", "2020-02-01", 3, "c"), (3, "r", "2020-06-01", 4, "c"), (4, "r", None, 5, "")]
    docs = spark.createDataFrame(rows, "company int, report string, date string, id int, chain string").withColumn("metrics", F.array(F.lit("m"), F.lit("k"), F.lit("m")))
    ids = lambda kind, n: sorted(r["ids"] for r in comparisons.groups_of(docs, kind, n).collect())
    assert ids("same_company_same_report_type", 2) == [] and ids("correction_chain", 3) == [[2, 3, 4]]
    assert ids("same_company_same_metric", 2) == [[1, 2]] and ids("cross_company_same_report_type", 2) == [[2, 3]]
    assert comparisons.groups_of(docs.limit(0), "correction_chain", 2).count() == 0
    with pytest.raises(ValueError):
        comparisons.groups_of(docs, "other", 2)
