import random

import pytest
from pyspark.sql import functions as F

from evidra.functions import dates as D
from evidra.functions import numbers as N
from evidra.functions import text as X
from evidra.operators import calc, catalog, chunking, coverage, datasets, grounding, retrieval
from evidra.sources import readers


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("literal", "bounds"),
    [("2023", (20230101, 20231231)), ("2023-Q2", (20230401, 20230630)), ("2023-H2", (20230701, 20231231)), ("2023-05-31", (20230531, 20230531)), ("2023-02-31", (None, None)), ("x", (None, None)), (None, (None, None))],
)
def test_period_bounds(spark, literal, bounds):
    lower, upper = D.period_bounds(F.lit(literal).cast("string"))
    assert tuple(spark.range(1).select(lower.alias("a"), upper.alias("b")).first()) == bounds


@pytest.mark.parametrize(
    ("question", "kind", "month"),
    [("2023년 1분기 매출", "quarter", 3), ("2분기", "quarter", 6), ("4분기", "quarter", 12), ("상반기 실적", "half", 6), ("연간 매출", "annual", 12), ("9월 실적", "month", 9), ("3월과 6월", None, None), ("5월 실적", None, None), ("분기별 매출", "any_quarter", None), ("2022 매출", "annual", 12), ("매출", None, None)],
)
def test_period_intent(spark, question, kind, month):
    got = spark.range(1).select(D.period_intent(F.lit(question)).alias("p")).first()["p"]
    assert ((got["kind"], got["month"]) if got else (None, None)) == (kind, month)


def test_dates_and_halves(spark):
    assert one(spark, D.date_key(F.lit("2023-02-31"))) is None
    assert one(spark, D.date_key(F.lit("20230228"))) == 20230228
    assert [one(spark, D.half_month(F.lit(h))) for h in ("H1", "H2", "x")] == [6, 12, None]
    assert one(spark, D.effective_basis(F.lit(None).cast("int"), F.lit(20230101), F.lit("event_date"))) == "rcept_dt"


def test_numbers(spark):
    assert one(spark, N.answer_numbers(F.lit("매출 3,249,918백만원, 2023년, 5"))) == ["3249918"]
    assert one(spark, N.answer_numbers(F.lit("in 2023 it was 3126 or 7"))) == ["3126"]
    assert one(spark, N.number_tokens(F.lit("74 % and 12"))) == ["74%", "12"]
    assert one(spark, grounding.unsupported_numbers(F.lit("12"), F.lit("3126"))) == ["12"]
    assert one(spark, grounding.unsupported_numbers(F.lit("74%"), F.lit("74 %"))) == []
    assert one(spark, N.normal_number(F.lit("97,000.00"))) == "97000"
    assert one(spark, N.percent_change(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, N.cagr(F.lit(0.0), F.lit(1.0), F.lit(2))) is None
    assert one(spark, N.convert_krw(F.lit(2.0), F.lit("억원"), F.lit("백만원"))) == 200
    assert one(spark, N.half_even(F.lit(2.5), 0)) == 2


def test_texts(spark):
    assert one(spark, X.clean(F.lit(" a　\n b "))) == "a b"
    assert one(spark, X.match_key(F.lit("Ab-c 가나!"))) == "abc가나"
    assert one(spark, X.lookup_key(F.lit("방산 기업"))) == "방산"
    assert one(spark, X.table_number(F.lit("d_table_007_part_02"))) == 7
    assert one(spark, X.part_number(F.lit("d_table_007_part_02"))) == 2
    assert one(spark, X.narrative_number(F.lit("x"))) is None
    assert one(spark, X.receipt_number(F.lit("a/20230317801144/x"))) == "20230317801144"
    assert one(spark, X.compress_cells(F.array(F.lit("a"), F.lit("a"), F.lit(""), F.lit("b")))) == ["a", "b"]
    assert one(spark, X.flatten_headers(F.array(F.array(F.lit("h"), F.lit("h")), F.array(F.lit("x"), F.lit("h"))), F.lit(2))) == ["h_x", "h"]
    head = "company and report and period "
    assert one(spark, X.join_parts(F.array(F.lit(head + "one"), F.lit(head + "two")))) == head + "one\ntwo"
    assert one(spark, X.json_object(F.lit('so: ```json {"a": "x}y", "b": 2}``` end'), "a string, b int")).asDict() == {"a": "x}y", "b": 2}
    assert one(spark, X.json_object(F.lit("{open"), "a string"))is None or one(spark, X.json_object(F.lit("{open"), "a string"))["a"] is None


def test_grid_and_table_parts(spark):
    grid = chunking.expand_grid([[("a", 2, 1), ("h", 1, 2)], [("x", 1, 1), ("y", 1, 1)], [("z", 1, 1)]])
    assert grid == [["a", "h", "h"], ["a", "x", "y"], ["z", "", ""]]
    rows = [["name", "value"], *[[f"row {k}", "v" * 60] for k in range(40)]]
    parts = chunking.split_table(rows, 1)
    assert all(p["rows"][0] == rows[0] for p in parts)
    assert [p["first_row"] for p in parts] == [2, *[p["last_row"] + 1 for p in parts[:-1]]] and parts[-1]["last_row"] == 41
    long = [["h"], ["a"], ["b" * 2000], ["c"]]
    assert [p["oversized"] for p in chunking.split_table(long, 1)] == [False, True, False]
    html = "<title>T</title><p>Intro text.</p><table><tr><th>n</th><th>value</th></tr><tr><td>sales total</td><td>1,000</td></tr></table>"
    docs = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert [tuple(r)[:4] for r in chunking.table_parts(docs, "html").select("id", "table_index", "part", "heads").collect()] == [(1, 1, 1, 1)]
    assert [r["paragraph"] for r in chunking.paragraphs(docs, "html").collect()] == ["Intro text."]


def test_sentence_packing(spark):
    def pack(text):
        return one(spark, chunking.pack_sentences(chunking.split_sentences(F.lit(text))))

    s = "x" * 298 + "."
    assert list(map(len, pack(" ".join([s] * 4)))) == [899, 899] or all(len(c) <= 900 for c in pack(" ".join([s] * 4)))
    assert pack("short.") == []
    assert all(len(c) <= 900 for c in pack("y" * 2000 + "."))
    assert pack("") == [] and one(spark, chunking.pack_sentences(chunking.split_sentences(F.lit(None).cast("string")))) == []


def test_fusion_rerank_pack(spark):
    ranked = spark.createDataFrame([(1, 1, "c", "a", 1), (1, 1, "c", "b", 2), (1, 2, "c", "a", 1), (1, 1, "d", "a", 2)], "question_id int, request_id int, chunk_id string, channel string, rank int")
    got = {r["chunk_id"]: r["fusion"] for r in retrieval.fuse(ranked).collect()}
    assert got["c"] == pytest.approx(1 / 61 + 1 / 62) and got["d"] == pytest.approx(1 / 62)
    rows = [(1, r, y, f"c{r}{y}{k}", 30_000, 0.9 - k / 10, 0.9 - k / 10, k < 2, r) for r in (1, 2) for y in (2021, 2022) for k in range(4) if not (r == 2 and y == 2022)]
    rows.append((1, 2, 2022, "weak", 100, 0.1, 0.1, False, 2))
    cand = spark.createDataFrame(rows, "question_id int, request_id int, year int, chunk_id string, chars int, query_score double, final_score double, qualified boolean, cell_order int")
    packed = coverage.pack(cand).collect()
    assert {(r["request_id"], r["year"]) for r in packed} >= {(1, 2021), (1, 2022), (2, 2022)}
    assert sum(30_000 if r["chunk_id"] != "weak" else 100 for r in packed) <= 70_000
    assert [r["fallback"] for r in packed if r["chunk_id"] == "weak"] == [True]


def test_long_chains_settle(spark, tmp_path):
    """A chain of 1,000 random ids is one class."""
    ids = random.Random(3).sample(range(1, 1 << 40), 1000)
    chain = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long").coalesce(1)
    rows = catalog.closure(chain, str(tmp_path)).collect()
    assert len(rows) == 1000 and {r["component"] for r in rows} == {min(ids)}


def test_closure_and_chains(spark, tmp_path):
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 6), (6, 5), (9, 9)], "src int, dst int")
    got = {r["node"]: r["component"] for r in catalog.closure(edges, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}


def test_calc_and_datasets(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0)], "g string, k int, v double")
    best = calc.extremes(df, ["g"], "k", "v").first()
    assert best["keys"] == [1, 2] and best["is_tie"]
    assert [r["rank"] for r in calc.competition_rank(df, ["g"], "v").orderBy("k").collect()] == [1, 1, 3]
    assert calc.evaluate(df, "nothing", ["v"]).first()["success"] is False
    with pytest.raises(ValueError):
        calc.assert_count(df, 4)
    assert [r["row_id"] for r in datasets.dense_ids(df, ["k"]).orderBy("k").collect()] == [0, 1, 2]
    asked = spark.createDataFrame([("A",), ("zz",)], "value string")
    names = catalog.aliases(spark.createDataFrame([(1, "A"), (2, "a!")], "code int, name string"), "code", ["name"])
    assert {r["value"]: r["status"] for r in catalog.resolve_direct(asked, names).collect()} == {"A": "ambiguous", "zz": "unknown"}
    with pytest.raises(ValueError):
        catalog.in_scope(df, "sector", ["q"], "k", "g")


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "1", "text": "x"}\n{"chunk_id": "2"')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "chunk_id string, text string", "drop").count() == 1
    kept = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "chunk_id string, text string", "keep").cache()
    assert kept.where("_corrupt_record IS NOT NULL").count() == 1
    (tmp_path / "w.json").write_text('{"items": [{"a": "1"}, {"a": "2"}]}')
    (tmp_path / "l.json").write_text('[{"a": "3"}]')
    assert sorted(r["a"] for p in ("w.json", "l.json") for r in readers.json_records(spark, str(tmp_path / p), "a string").collect()) == ["1", "2", "3"]
    (tmp_path / "u.csv").write_text("﻿code,name\n00126380,x\n00000001,\n", encoding="utf-8")
    assert [tuple(r) for r in readers.text_csv(spark, str(tmp_path / "u.csv"), ["code", "name"]).orderBy("code").collect()] == [("00000001", ""), ("00126380", "x")]
    deep = tmp_path / "raw" / "20230317801144"
    deep.mkdir(parents=True)
    (deep / "f.xml").write_text("<p>a & b</p>")
    raw = readers.raw_files(spark, str(tmp_path / "raw")).select("receipt", readers.escape_markup(F.col("content")).alias("c")).first()
    assert tuple(raw) == ("20230317801144", "<p>a &amp; b</p>")
    vectors = spark.createDataFrame([("c1", "k"), ("c1", "k"), ("c2", "m")], "chunk_id string, corp_name string")
    assert readers.write_vectors(vectors, str(tmp_path / "v"), expected=2).count() == 2


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from evidra.streaming.events import window_totals

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = window_totals(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), late="40 days")
    q = stream.writeStream.format("memory").queryName("totals").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, window_totals(table).collect()))


def test_grounding(spark):
    assert one(spark, grounding.insufficient(F.lit("답변이 불가합니다")))
    assert one(spark, grounding.valid_source_ids(F.array(F.lit("2"), F.lit("9"), F.lit("2"), F.lit("x"), F.lit("1")), F.lit(3))) == [2, 1]
    attempts = spark.createDataFrame([(1, 1, True, False), (1, 2, True, True), (2, 1, True, True), (2, 2, True, True)], "q int, attempt int, answerable boolean, valid boolean")
    assert {r["q"]: r["attempt"] for r in grounding.choose_attempt(attempts, "q").collect()} == {1: 2, 2: 1}
    rows = spark.createDataFrame([(1, "head\nsales | 500\nother token\nnothing", ["500"], ["token"])], "id int, text string, numbers array<string>, terms array<string>")
    assert grounding.evidence_lines(rows, ["id"], "text", "numbers", "terms").first()["lines"] == ["head", "sales | 500", "other token"]


def test_upsert_paths_and_lenient_lines(spark, tmp_path):
    import unicodedata

    from evidra.sources import readers

    path = str(tmp_path / "vectors")
    first = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 1.0), ("b", "y", 2.0)], "chunk_id string, corp_name string, v double")
    assert readers.upsert_vectors(first, path).count() == 2
    more = spark.createDataFrame([("b", "y", 9.0), ("c", "y", 3.0)], first.schema)
    assert sorted(map(tuple, readers.upsert_vectors(more, path).select("chunk_id", "v").collect())) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    name = unicodedata.normalize("NFD", "가나.jsonl")
    (tmp_path / name).write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    asked = str(tmp_path / unicodedata.normalize("NFC", "가나.jsonl"))
    assert readers.found_path(spark, asked) is not None and readers.found_path(spark, asked + "x") is None
    assert sorted(r["k"] for r in readers.lenient_lines(spark, asked, "k int").collect()) == [1, 2]
    assert readers.lenient_lines(spark, asked + "x", "k int").count() == 0


def test_html_fields(spark):
    page = "<title>T &amp; U</title><!-- <tr><td>x</td><td>y</td></tr> --><table><tr><td>a</td><td>Name</td><td><b>Kim</b>&nbsp;</td></tr><TR class='r'><td>Note</td></TR><tr><td>long text</td></tr><tr><td>lost</td></tr><tr><td>Name</td><td>Lee</td></tr><tr><td>Empty</td><td> </td></tr><tr><td>tail</td></tr></table>"
    docs = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<tr></tr><td>")], "doc_id int, html string")
    got = {r["doc_id"]: (r["title"], [tuple(f) for f in r["fields"]]) for r in readers.html_fields(docs, "doc_id", "html").collect()}
    assert got == {1: ("T & U", [("Name", "Kim"), ("Note", "long text"), ("Name 2", "Lee")]), 2: ("", []), 3: ("", []), 4: ("", [])}


def test_calculation_plans(spark):
    from evidra.operators import calculation

    plans = spark.createDataFrame([(1, True, "sum"), (2, True, "ratio"), (3, False, "sum"), (4, True, "nope"), (5, True, None), (6, None, None), (7, True, "cagr"), (8, True, "mean")], "plan_id int, answerable boolean, operation string")
    sources = spark.createDataFrame([(1, "a"), (2, "a"), (2, "z"), (2, "y"), (3, None), (7, "a"), (7, "a")], "plan_id int, source_id string")
    chunks = spark.createDataFrame([(1, "a"), (2, "a"), (7, "a"), (1, "z")], "plan_id int, source_id string")
    facts = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, float("nan")), (1, 4, 5.0), (7, 1, 100.0), (7, 2, 121.0), (7, 3, 2.0)], "plan_id int, position int, value double")
    checked = calculation.checked_plans(plans, sources, chunks)
    got = {r["plan_id"]: (r["fault"], None if r["result"] is None else round(r["result"], 6), r["status"]) for r in calculation.run_plans(checked, facts).collect()}
    assert got == {
        1: (None, 7.0, "ok"), 2: ("unknown sources: y, z", None, "fault"), 3: (None, None, "insufficient"), 4: ("unsupported operation: nope", None, "fault"),
        5: ("unsupported operation: none", None, "fault"), 6: (None, None, "insufficient"), 7: (None, 10.0, "ok"), 8: (None, None, "undefined"),
    }
    assert sorted(map(tuple, calculation.selected_sources(checked, sources, chunks).collect())) == [(1, "a"), (7, "a")]
    assert calculation.run_plans(calculation.checked_plans(plans.limit(0), sources, chunks), facts).count() == 0
