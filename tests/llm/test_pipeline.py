"""The corpus pipeline, stage by stage, against plain versions of its decisions."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P

from .test_operators import EDGES, SCHEMA, brute_classes


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name != "SentencePiece":
            assert out.columns == docs.columns
        kept[name] = (docs, out)
        docs = out
    before, after = kept["language ID"]
    assert after.count() >= 0.98 * before.where("text RLIKE '[a-zA-Z]'").count()
    before, after = kept["n-gram Jaccard join"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {d for (d, _, c) in brute_classes(rows, P.NEAR) if d == c}
    assert {r["doc_id"] for r in after.collect()} == want
    before, after = kept["secret scans"]
    assert before.count() == after.count() and after.where("text RLIKE 'AKIA[A-Z0-9]{14}|[0-9a-f]{16}'").count() == 0
    before, after = kept["mixing sources"]
    times = Counter(r["doc_id"] for r in after.collect())
    assert set(times) <= {r["doc_id"] for r in before.collect()} and max(times.values()) <= 2
    before, after = kept["SentencePiece"]
    assert before.count() == after.count() == after.where("round_trip AND size(piece_ids) = n_pieces").count()


def test_edge_rows_and_empty_tables(spark, tmp_path):
    rows = [(i, t, "en", None, None, "x", 7, None) for i, t in EDGES]
    for name, table in (("odd", spark.createDataFrame(rows, SCHEMA)), ("none", spark.createDataFrame([], SCHEMA))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = P.run(spark, str(tmp_path / name))
        assert {"piece_ids", "labels", "node", "id"} <= set(out.columns)
        assert out.where("NOT round_trip").count() == 0


def test_rows_are_decided_by_themselves_whatever_their_columns(spark):
    """Repeated ids with other texts, and columns that have the names of every operator's own."""
    body = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf every single day of the year"
    rows = [(5, body), (9, body + " again"), (9, "something else entirely that has nothing to do with animals in a forest"), (11, "Z z z z"), (11, "Z z z z"), (11, "Z z z z end of it all"), (None, "a row without an id that stays"), (None, "A row without an id that stays")]
    own = ["found", "score", "lang_pred", "n_pieces", "ids_crc32", "round_trip", "piece_ids", "id", "kinds", "node", "component", "class_id", "rate", "copies", "n_bytes_fallback", "labels", "odd name", "_mark", "_kept", "_same", "_same_mark", "_kept_mark", "_row", "row", "_mix_source", "mix_source", "_mix_rate", "_mix_copy", "col", "size", "source_size", "a.b", "_text", "_id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", *[f"'x {c}' AS `{c}`" for c in own])
    kept = P.drop_near_duplicates(spark, docs, "")
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, body), rows[2], (11, "Z z z z"), rows[5], (None, min(rows[6][1], rows[7][1], key=lambda t: __import__("hashlib").md5(t.encode()).hexdigest()))], key=str)
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        assert len(set(out.columns)) == len(out.columns) and set(docs.columns) <= set(out.columns)
        docs = out if name == "mixing sources" else docs
        assert out.count() > 0, name
        if name != "SentencePiece":
            assert all(tuple(r)[4:] == tuple(f"x {c}" for c in own) for r in out.collect()), name
