"""Blocked exact search and the inverted file, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from evidra.operators import vectors


def brute(chunks, questions, k, same, per):
    out = []
    for q in questions:
        if q["v"] is None or any(x is None for x in q["v"]):
            continue
        scored = {}
        for c in chunks:
            if c["vector"] is None or any(x is None or not np.isfinite(x) for x in c["vector"]) or (same and (c["label"] is None or c["label"] != q["label"])):
                continue
            a, b = np.array(c["vector"], float), np.array(q["v"], float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            scored.setdefault(c["label"] if per else None, []).append((-round(float(a @ b) / norm, 6) if norm else 0.0, c["chunk_id"]))
        for group, rows in scored.items():
            out += [(q["q"], group, c, -s, i + 1) for i, (s, c) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def tables(spark, n=400, size=8, seed=0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(12)]
    make = lambda: [x + draw.gauss(0, 0.3) for x in draw.choice(centres)]
    chunks = [{"chunk_id": k, "label": draw.choice([1, 2, 3, None]), "vector": make()} for k in range(n)]
    for k in range(0, 60, 3):
        chunks[k]["vector"] = chunks[1]["vector"]  # ties
    chunks[5]["vector"], chunks[6]["vector"], chunks[7]["vector"], chunks[8]["vector"] = None, [0.0] * size, [None] + [1.0] * (size - 1), [float("nan")] * size
    questions = [{"q": k, "label": draw.choice([1, 2, 3, None]), "v": make()} for k in range(25)]
    questions[3]["v"], questions[4]["v"] = None, chunks[1]["vector"]
    a = spark.createDataFrame(chunks, "chunk_id long, label int, vector array<double>").repartition(4)
    b = spark.createDataFrame(questions, "q long, label int, v array<double>")
    return chunks, questions, a, b


@pytest.mark.parametrize("small", [False, True])
def test_blocks_lose_nothing(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vectors, "QUESTION_BYTES", 500)
        monkeypatch.setattr(vectors, "QUESTION_BLOCK", 3)
        monkeypatch.setattr(vectors, "HELD", 20)
    chunks, questions, a, b = tables(spark, 200 if small else 400)
    got = [(r["q"], None, r["chunk_id"], r["score"], r["rank"]) for r in vectors.top_k(a, b.drop("label"), [], 7, query_vector="v").collect()]
    assert sorted(got, key=str) == brute(chunks, questions, 7, False, False)
    got = [(r["q"], r["label"], r["chunk_id"], r["score"], r["rank"]) for r in vectors.top_k(a, b.drop("label"), [], 3, query_vector="v", per=["label"]).collect()]
    assert sorted(got, key=str) == brute(chunks, questions, 3, False, True)
    got = [(r["q"], None, r["chunk_id"], r["score"], r["rank"]) for r in vectors.top_k(a, b, ["label"], 5, query_vector="v").collect()]
    assert sorted(got, key=str) == brute(chunks, [q for q in questions if q["label"]], 5, True, False)
    assert vectors.top_k(a.limit(0), b, ["label"], 5, query_vector="v").count() == 0 == vectors.top_k(a, b.limit(0), ["label"], 5, query_vector="v").count()


def test_index_is_exact_when_sure_and_near_when_not(spark, tmp_path):
    chunks, questions, a, b = tables(spark, 3000, seed=5)
    index = vectors.build_index(a, str(tmp_path / "index"), cells=40, sample=1000)
    assert index.data.count() == sum(c["vector"] is not None and None not in c["vector"] and all(map(np.isfinite, c["vector"])) for c in chunks)
    asked = [q for q in questions if q["label"]]
    want = brute(chunks, asked, 10, True, False)
    sure = vectors.indexed_top_k(vectors.open_index(spark, str(tmp_path / "index")), b.where("label IS NOT NULL"), ["q"], ["label"], 10, sure=True, query_vector="v")
    assert sorted(((r["q"], None, r["chunk_id"], r["score"], r["rank"]) for r in sure.collect()), key=str) == want
    near = {(r["q"], r["chunk_id"]) for r in vectors.indexed_top_k(index, b.where("label IS NOT NULL"), ["q"], ["label"], 10, growth=(300, 1000, 3000), query_vector="v").collect()}
    exact = {(q, c) for q, _, c, _, _ in want}
    assert len(near & exact) >= 0.9 * len(exact) and len(near) == len(exact)
    probes = vectors._probes(b.where("label IS NOT NULL AND v IS NOT NULL"), index, "v")
    read = probes.where("ahead < 300").join(index.cells, "cell").groupBy("q").agg({"n": "sum"}).agg({"sum(n)": "avg"}).first()[0]
    assert read < 0.25 * index.data.count()  # the rows of the cells that the first step reads


def test_index_sends_each_question_once_a_step(spark, tmp_path, monkeypatch):
    """Not once for each cell that it asks for; a cell is a few files; small blocks, no keys and too few hits change nothing."""
    chunks, questions, a, b = tables(spark, 2000, seed=9)
    index = vectors.build_index(a.repartition(4), str(tmp_path / "index"), cells=30, sample=1000)
    assert len(index.data.inputFiles()) <= 30 + 4
    sent, plain = [], vectors._cells_pass
    monkeypatch.setattr(vectors, "_cells_pass", lambda *args: (sent.append(args[2].num_rows), plain(*args))[1])
    got = vectors.indexed_top_k(index, b, ["q"], ["label"], 10, sure=True, query_vector="v").collect()
    assert sorted(((r["q"], None, r["chunk_id"], r["score"], r["rank"]) for r in got), key=str) == brute(chunks, [q for q in questions if q["label"]], 10, True, False)
    assert sum(sent) <= 2 * len(questions)
    monkeypatch.setattr(vectors, "QUESTION_BYTES", 500)
    monkeypatch.setattr(vectors, "PRODUCT", 100)
    monkeypatch.setattr(vectors, "HELD", 50)
    got = vectors.indexed_top_k(index, b.drop("label"), ["q"], [], 150, sure=True, growth=(40,), query_vector="v").collect()
    assert sorted(((r["q"], None, r["chunk_id"], r["score"], r["rank"]) for r in got), key=str) == brute(chunks, questions, 150, False, False)
    assert vectors.indexed_top_k(index, b.limit(0), ["q"], ["label"], 5, sure=True, query_vector="v").count() == 0
