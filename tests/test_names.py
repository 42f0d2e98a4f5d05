"""Names in texts and names nearly alike, against plain searches."""

from __future__ import annotations

import random

import pytest

from evidra.operators import fuzzy, mentions


def test_automaton_finds_every_place():
    draw = random.Random(2)
    for _ in range(20):
        words = list({"".join(draw.choices("abc가", k=draw.randint(1, 5))) for _ in range(draw.randint(1, 40))})
        automaton = mentions.Automaton(words)
        text = "".join(draw.choices("abc가x", k=draw.randint(1, 3000)))
        places = automaton.find(automaton.signs(mentions.code_points(text)))
        assert sorted(zip(*[x.tolist() for x in places], strict=True)) == sorted((i + len(w) - 1, k) for k, w in enumerate(words) for i in range(len(text)) if text.startswith(w, i))


@pytest.mark.parametrize("signs", [1 << 20, 7])  # one automaton, and many
def test_places_are_of_the_text_itself(spark, monkeypatch, signs):
    monkeypatch.setattr(mentions, "PART_SIGNS", signs)
    rows = [(1, "The Old  Wid-get, old widget!"), (1, "The Old  Wid-get, old widget!"), (2, None), (3, ""), (4, "x" * 70_000 + "K2 삼 성"), (None, "getold")]
    texts = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "'n' AS name", "1 AS start").repartition(3)
    names = spark.createDataFrame([("old widget",), ("OLD",), ("widget old",), ("k",), (None,), ("삼성",), ("k2삼",)], "n string")
    got = sorted(((r["id"] or 0), r["name"], r["start"], r["end"]) for r in mentions.occurrences(texts, "text", names, "n", ["id"]).collect())
    twice = [(1, "old", 4, 7), (1, "old", 18, 21), (1, "oldwidget", 4, 16), (1, "oldwidget", 18, 28), (1, "widgetold", 9, 21)]
    assert got == sorted([*twice, *twice, (4, "k2삼", 70_000, 70_004), (4, "삼성", 70_003, 70_006), (0, "old", 3, 6)])
    assert mentions.occurrences(texts, "text", names.limit(0), "n", ["id"]).count() == 0
    assert mentions.occurrences(texts.limit(0), "text", names, "n", ["id"]).count() == 0


def test_what_a_text_names(spark):
    names = spark.createDataFrame([("alpha", "A"), ("alpha one", "A"), ("beta", "B"), ("beta", "B2"), ("gamma", "G"), ("gam", None)], "name string, code string")
    texts = spark.createDataFrame([(1, "gamma and Alpha One"), (2, "beta or gamma"), (3, "none")], "id long, text string")
    got = {(r["id"], r["name"], r["codes"], r["code"], r["place"]) for r in mentions.companies_in(texts, "text", names, "name", "code", ["id"]).collect()}
    assert got == {(1, "alphaone", 1, "A", 1), (1, "gamma", 1, "G", 2), (2, "beta", 2, None, 1)}
    assert {tuple(r) for r in mentions.ambiguity_groups(names, "name", "code").collect()} == {("beta", "B"), ("beta", "B2")}


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


def test_common_signs_equal_the_table():
    draw = random.Random(4)
    for _ in range(500):
        a, b = ("".join(draw.choices("abcd", k=draw.randint(0, 90 if _ < 50 else 9))) for _ in range(2))
        assert fuzzy.common_signs(a, b) == longest_common(a, b)


@pytest.mark.parametrize("percent", [80, 90, 65])
def test_near_names_lose_no_pair_and_compare_few(spark, percent):
    draw = random.Random(percent)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = list({"".join(draw.choices(letters, k=draw.randint(1, 14))) for _ in range(300)})
    values = [n[:k] + draw.choice(letters) * draw.randint(0, 2) + n[k + draw.randint(0, 1) :] for n in names for k in [draw.randrange(len(n))]] + ["", "aa", "aaaa"]
    a, b = (spark.createDataFrame([(x,) for x in [*side, side[0], None]], "key string") for side in (values, names))
    got = sorted(tuple(r) for r in fuzzy.similar(a, b, percent).collect())
    want = sorted({(v, n, 200 * c / (len(v) + len(n))) for v in values for n in names if v for c in [longest_common(v, n)] if 200 * c >= percent * (len(v) + len(n))})
    assert got == want and len(got) > 100
    if percent == 80:
        assert fuzzy.candidate_pairs(a.where("key <> ''").distinct(), b.where("key <> ''").distinct(), percent).count() < 0.2 * len(values) * len(names)
    assert fuzzy.similar(a.limit(0), b, percent).count() == 0


def test_words_go_to_the_name_most_like_them(spark):
    names = spark.createDataFrame([("삼성전자", "S"), ("widget", "W"), ("widgets", "V"), ("widgets", "X")], "name string, code string")
    texts = spark.createDataFrame([(1, "삼성전지는 어떤가"), (2, "a widgt here"), (3, "the widget itself"), (4, "nothing alike")], "id long, text string")
    got = {(r["id"], r["word"], r["name"], r["code"]) for r in fuzzy.companies_nearly_in(texts, "text", names, "name", "code", ["id"], 70).collect()}
    assert got == {(1, "삼성전지", "삼성전자", "S"), (2, "widgt", "widget", "W")}
