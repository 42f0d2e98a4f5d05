"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, gru_lm, jaccard_join, language_id, lattice_dedup, mixing, mpeg_audio, pieces, quality, resampling, secret_scan, token_store, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpeg_audio": lambda spark, sf_dir: mpeg_audio.query(table(spark, sf_dir, "documents")),
    "op2_token_store": token_store.query,
    "op3_lattice_dedup": lambda spark, sf_dir: lattice_dedup.query(table(spark, sf_dir, "embeddings")),
    "op4_language_id": lambda spark, sf_dir: language_id.query(table(spark, sf_dir, "documents")),
    "op5_toxicity": toxicity.query,
    "op6_gru_lm": lambda spark, sf_dir: gru_lm.query(table(spark, sf_dir, "documents")),
    "op7_secret_scan": lambda spark, sf_dir: secret_scan.query(table(spark, sf_dir, "documents")),
    "op8_mix_sources": lambda spark, sf_dir: mixing.query(table(spark, sf_dir, "documents")),
    "op9_sentence_pieces": pieces.query,
    "op10_jaccard_join": lambda spark, sf_dir: jaccard_join.query(table(spark, sf_dir, "documents")),
    "op11_crc_resampling": resampling.query,
    "op12_fourier_quality": quality.query,
    "op13_source_divergence": lambda spark, sf_dir: divergence.query(table(spark, sf_dir, "documents")),
}
#: Smallest reachable id of each node, by the closure of the links (x, y).
_REACHED = """edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT DISTINCT x AS node, x AS other FROM edges UNION SELECT r.node, b.y FROM reached r JOIN edges b ON b.x = r.other),
least AS (SELECT node, min(other) AS component FROM reached GROUP BY node)"""
_LATTICE = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
{_REACHED}, degree AS (SELECT x, count(*) AS n FROM edges GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN degree ON x = vec_id LEFT JOIN least ON node = vec_id"""
_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS shingles FROM w),
sizes AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM sets), parts AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM parts a JOIN parts b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * met.n >= 85 * (a.n + b.n - met.n)),
{_REACHED}
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id FROM sizes LEFT JOIN least ON node = doc_id"""
ORACLE_SQL: dict[str, str] = {
    "op3_lattice_dedup": _LATTICE,
    "op7_secret_scan": secret_scan.SQL,
    "op8_mix_sources": mixing.SQL,
    "op10_jaccard_join": _JACCARD,
    "op11_crc_resampling": resampling.SQL,
    "op13_source_divergence": divergence.SQL,
}
