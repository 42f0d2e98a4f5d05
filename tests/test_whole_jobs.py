"""Registered queries without SQL do the whole job, not a cut of it."""

from evidra.operators import coverage
from evidra.plans import catalogue


def test_evidence_lines_take_every_number(spark, tmp_path):
    text = "\n".join(f"line {n}" for n in range(11, 100, 11))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.evidence_line_pick(spark, str(tmp_path)).first()["lines"] == text.split("\n")


def test_packing_asks_every_fiftieth_vector(spark, sf_dir):
    ids = [r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()]
    got = {r["question_id"] for r in catalogue.pack_context(spark, sf_dir).select("question_id").distinct().collect()}
    assert got == {(v // 50 + 1) // 2 for v in ids}


def test_packing_reaches_past_long_chunks(spark):
    """The only chunk that fits the budget is the last of its cell by either order."""
    rows = [(1, 1, 2020, k, 80_000 if k < 300 else 100, 1 - k / 1000, 1 - k / 1000, True, 1) for k in range(301)]
    cand = spark.createDataFrame(rows, "question_id int, request_id int, year int, chunk_id int, chars int, query_score double, final_score double, qualified boolean, cell_order int")
    assert [r["chunk_id"] for r in coverage.pack(cand).collect()] == [300]
