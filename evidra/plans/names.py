"""Registered queries over names in texts: places, companies named, near names, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fuzzy, mentions
from .registry import query, t

_KEY = "regexp_replace(lower(coalesce({}, '')), '[^0-9a-z가-힣]+', '', 'g')"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    return docs.unionByName(t(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", "text"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, and the longer words of the benchmark's items: some words are of several items."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))))
    items = t(spark, sf_dir, "benchmark").select(words.alias("name"), F.concat(F.lit("item "), F.col("item_id")).alias("code"))
    return t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("code")).distinct().unionByName(items)


_NAMES = f"""texts AS (SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS turn, text FROM documents UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations),
named AS (SELECT DISTINCT p_name AS name, p_name AS code FROM part UNION ALL SELECT unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{{6,}}'))), 'item ' || item_id FROM benchmark),
alias AS (SELECT {_KEY.format("name")} AS key, count(DISTINCT code) AS codes, min(code) AS code FROM named GROUP BY 1),
folded AS (SELECT row_number() OVER () AS row, kind, id, turn, {_KEY.format("text")} AS folded, list_filter(range(1, length(coalesce(text, '')) + 1), lambda i: regexp_matches(lower(string_split(text, '')[i]), '[0-9a-z가-힣]')) AS spots FROM texts),
piece AS (SELECT row, kind, id, turn, spots, b, substring(folded, b + 1, 64 + 40) AS piece, length(folded) AS size FROM (SELECT *, unnest(range(0, length(folded), 64)) AS b FROM folded)),
cut AS (SELECT *, unnest(range(1, 65)) AS i FROM piece),
found AS (SELECT kind, id, turn, spots, key, b + i AS first FROM (SELECT cut.*, n FROM cut, (SELECT DISTINCT length(key) AS n FROM alias)) c JOIN alias ON key = substring(piece, i, n) WHERE b + i + n - 1 <= size)"""


@query(f"WITH {_NAMES} SELECT kind, id, turn, key AS name, spots[first] - 1 AS start, spots[first + length(key) - 1] AS \"end\" FROM found")
def name_places(spark, sf_dir):
    return mentions.occurrences(_texts(spark, sf_dir), "text", _names(spark, sf_dir), "name", ["kind", "id", "turn"])


@query(f"""WITH {_NAMES}, met AS (SELECT DISTINCT kind, id, turn, key, codes, code FROM found JOIN alias USING (key)),
own AS (SELECT *, max(codes) OVER (PARTITION BY kind, id, turn) AS most FROM met),
once AS (SELECT *, row_number() OVER (PARTITION BY kind, id, turn, code, codes > 1 ORDER BY length(key) DESC, key) AS n FROM own WHERE most = 1 OR codes > 1)
SELECT kind, id, turn, key AS name, codes, CASE WHEN codes = 1 THEN code END AS code, row_number() OVER (PARTITION BY kind, id, turn ORDER BY length(key) DESC, key)::INT AS place FROM once WHERE codes > 1 OR n = 1""")
def companies_named(spark, sf_dir):
    return mentions.companies_in(_texts(spark, sf_dir), "text", _names(spark, sf_dir), "name", "code", ["kind", "id", "turn"])


@query(f"""WITH named AS (SELECT DISTINCT p_name AS name, p_type AS code FROM part) SELECT {_KEY.format("name")} AS name, code FROM named
WHERE {_KEY.format("name")} IN (SELECT {_KEY.format("name")} FROM named GROUP BY 1 HAVING count(DISTINCT code) > 1)""")
def ambiguity_groups(spark, sf_dir):
    return mentions.ambiguity_groups(t(spark, sf_dir, "part").select("p_name", "p_type").distinct(), "p_name", "p_type")


def _misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name as one word that lacks a letter (of every third part: that has one twice), place by its number."""
    key, at = X.match_key("p_name"), F.col("p_partkey") % F.length(X.match_key("p_name"))
    head, tail = F.left(key, at.cast("int")), F.substring(key, at.cast("int") + 1, F.lit(99))
    return t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(head, F.left(tail, F.lit(1)), tail)).otherwise(F.concat(head, F.substring(tail, 2, 99))).alias("word"), "p_type")


_MISSPELT = """k AS (SELECT p_partkey, p_type, regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') AS key FROM part),
typed AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 3 = 0 THEN left(key, p_partkey % length(key)) || substring(key, p_partkey % length(key) + 1, 1) || substring(key, p_partkey % length(key) + 1)
  ELSE left(key, p_partkey % length(key)) || substring(key, p_partkey % length(key) + 2) END AS word FROM k)"""
_LIKE = """pairs AS (SELECT value, name, length(name) AS n, length(value) AS m, list_transform(string_split(value, ''), lambda c: list_sum(list_transform(range(length(name)), lambda i: CASE WHEN substring(name, i + 1, 1) = c THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT) AS masks FROM value, name),
likes AS (SELECT value, name, n, m, list_reduce(list_prepend((1::BIGINT << n) - 1, masks), lambda r, x: ((r + (r & x)) | (r - (r & x))) & ((1::BIGINT << n) - 1)) AS row FROM pairs),
alike AS (SELECT value, name, 200::DOUBLE * (n - bit_count(row)) / (n + m) AS ratio FROM likes WHERE 200 * (n - bit_count(row)) >= 80 * (n + m))"""


@query(f"""WITH {_MISSPELT}, value AS (SELECT DISTINCT word AS value FROM typed WHERE word <> ''), name AS (SELECT DISTINCT key AS name FROM k), {_LIKE} SELECT value, name, ratio FROM alike""")
def similar_names(spark, sf_dir):
    names = t(spark, sf_dir, "part").select(X.match_key("p_name").alias("key"))
    return fuzzy.similar(_misspelt(spark, sf_dir).select(F.col("word").alias("key")), names)


@query(f"""WITH {_MISSPELT}, alias AS (SELECT key AS name, count(DISTINCT p_type) AS codes, min(p_type) AS code FROM k GROUP BY 1),
asked AS (SELECT p_partkey, 'is ' || word || ' of ' || lower(p_type) AS text FROM typed), folded AS (SELECT *, regexp_replace(text, '[^0-9a-z]+', '', 'g') AS f FROM asked),
without AS (SELECT * FROM folded WHERE NOT EXISTS (SELECT 1 FROM alias WHERE contains(f, name))),
words AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS word FROM without), value AS (SELECT DISTINCT word AS value FROM words WHERE length(word) >= 2), name AS (SELECT name FROM alias), {_LIKE},
best AS (SELECT value, name, ratio, row_number() OVER (PARTITION BY value ORDER BY ratio DESC, name) AS n FROM alike)
SELECT p_partkey, word, name, codes, CASE WHEN codes = 1 THEN code END AS code, ratio FROM words JOIN best ON value = word AND n = 1 JOIN alias USING (name)""")
def companies_nearly_named(spark, sf_dir):
    asked = _misspelt(spark, sf_dir).select("p_partkey", F.concat(F.lit("is "), F.col("word"), F.lit(" of "), F.lower("p_type")).alias("text"))
    return fuzzy.companies_nearly_in(asked, "text", t(spark, sf_dir, "part"), "p_name", "p_type", ["p_partkey"])
