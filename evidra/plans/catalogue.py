"""The registered queries over the driver's tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as X
from ..operators import calc, catalog, chunking, coverage, datasets, grounding, retrieval, vectors
from ..shared import scratch
from ..streaming import events as streams
from .registry import QUERIES, SQL, money, query, t

def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose number is divisible by 50, as request vec_id / 50; requests 2q - 1 and 2q are of question q."""
    request = (F.col("vec_id") / 50).cast("long")
    e = t(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return e.select(F.floor((request + 1) / 2).cast("int").alias("question_id"), request.alias("request_id"), F.col("embedding").alias("query_vector"))


def _found(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    chunks = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.col("embedding").alias("vector"))
    return retrieval.search(chunks, _questions(spark, sf_dir), [], k, per=["doc_id"])


_FOUND = """q AS (SELECT ((vec_id // 50 + 1) // 2)::INT AS question_id, vec_id // 50 AS request_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT question_id, request_id, label AS doc_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS score FROM embeddings, q),
found AS (SELECT *, row_number() OVER (PARTITION BY question_id, request_id, doc_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""


@query("""WITH q AS (SELECT vec_id AS question, label, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT question, label, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS score FROM embeddings JOIN q USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def index_search(spark, sf_dir):
    """Through the inverted file, sure: among the vectors of the question's label."""
    e = t(spark, sf_dir, "embeddings")
    index = vectors.build_index(e.select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("vector")), scratch(spark, "vector-index"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), "label", F.col("embedding").alias("query_vector"))
    return vectors.indexed_top_k(index, asked, ["question"], ["label"], 10, sure=True)


@query(f"WITH {_FOUND} SELECT question_id, request_id, doc_id, chunk_id, score, rank::INT AS rank FROM found WHERE rank <= 10")
def vec_topk_filtered(spark, sf_dir):
    return _found(spark, sf_dir, 10)


@query(f"""WITH {_FOUND}, g AS (SELECT question_id, request_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS f FROM found WHERE rank <= 10 GROUP BY ALL)
SELECT question_id, chunk_id, round(max(f), 9) AS fusion FROM g GROUP BY ALL""")
def rrf_fusion(spark, sf_dir):
    ranked = _found(spark, sf_dir, 10).withColumn("channel", F.lit("query_dense"))
    return retrieval.fuse(ranked).withColumn("fusion", F.round("fusion", 9))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query scores by one request's vector, keyword scores by that of its neighbour."""
    odd = F.col("request_id") % 2 == 1
    pair = Window.partitionBy("question_id", "chunk_id")
    other = F.when(odd, F.max(F.when(~odd, F.col("score"))).over(pair)).otherwise(F.max(F.when(odd, F.col("score"))).over(pair))
    return _found(spark, sf_dir, 20).select("question_id", "request_id", "doc_id", "chunk_id", F.col("score").alias("query_score"), other.alias("keyword_score"))


_SCORED = f"""{_FOUND}, top AS (SELECT * FROM found WHERE rank <= 20),
scored AS (SELECT a.question_id, a.request_id, a.doc_id, a.chunk_id, a.score AS query_score, b.score AS keyword_score FROM top a
  LEFT JOIN top b ON a.question_id = b.question_id AND a.chunk_id = b.chunk_id AND b.request_id = CASE WHEN a.request_id % 2 = 1 THEN a.request_id + 1 ELSE a.request_id - 1 END),
final AS (SELECT *, CASE WHEN keyword_score IS NULL THEN query_score ELSE (0.8::DOUBLE * query_score + 0.2::DOUBLE * keyword_score) / (0.8::DOUBLE + 0.2::DOUBLE) END AS f FROM scored)"""


@query(f"""WITH {_SCORED}, placed AS (SELECT *, row_number() OVER (PARTITION BY question_id, request_id, doc_id ORDER BY f DESC, chunk_id) AS n FROM final),
m AS (SELECT *, max(f) OVER (PARTITION BY question_id, chunk_id) AS r, min(n) OVER (PARTITION BY question_id, chunk_id) AS best FROM placed)
SELECT question_id, request_id, doc_id, chunk_id, round(f, 6) AS final_score, round(r, 6) AS rerank_score FROM m WHERE best <= 10""")
def weighted_rerank(spark, sf_dir):
    out = retrieval.rerank(_scored(spark, sf_dir))
    return out.select("question_id", "request_id", "doc_id", "chunk_id", F.round("final_score", 6).alias("final_score"), F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {_SCORED} SELECT question_id, request_id, chunk_id,
 coalesce(query_score >= greatest(0.55::DOUBLE, 0.85::DOUBLE * max(query_score) OVER w) AND f >= 0.9::DOUBLE * max(f) OVER w, false) AS qualified
 FROM final WINDOW w AS (PARTITION BY question_id, request_id)""")
def qualify_cells(spark, sf_dir):
    ranked = retrieval.rerank(_scored(spark, sf_dir), keep=20)
    return retrieval.qualify(ranked).select("question_id", "request_id", "chunk_id", "qualified")


@query()
def pack_context(spark, sf_dir):
    ranked = retrieval.qualify(retrieval.rerank(_scored(spark, sf_dir), keep=20))
    rows = ranked.select("question_id", "request_id", F.col("doc_id").cast("int").alias("year"), "chunk_id", F.lit(2500).alias("chars"), "query_score", "final_score", "qualified", F.col("request_id").alias("cell_order"))
    return coverage.pack(rows)


@query("""WITH asked AS (SELECT o_custkey AS c, unnest(range(1995, 2002)) AS year FROM (SELECT DISTINCT o_custkey FROM orders)),
had AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS year FROM orders)
SELECT c AS company, year::INT AS year FROM asked WHERE NOT EXISTS (SELECT 1 FROM had WHERE had.c = asked.c AND had.year = asked.year)""")
def missing_cells(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"))
    asked = coverage.cells(o.select("company").distinct(), ["company"], F.lit(1995), F.lit(2001))
    return coverage.missing_cells(asked, o, ["company"])


@query("""WITH asked AS (SELECT o_custkey AS c, unnest(range(1995, 2002)) AS year FROM (SELECT DISTINCT o_custkey FROM orders)),
had AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS year FROM orders)
SELECT asked.c AS company, count(*) AS expected, count(had.c) AS covered, coalesce(list(asked.year::INT ORDER BY asked.year) FILTER (had.c IS NULL), []) AS missing
FROM asked LEFT JOIN had ON had.c = asked.c AND had.year = asked.year GROUP BY 1""")
def coverage_cells(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"))
    return coverage.coverage_summary(coverage.cells(o.select("company").distinct(), ["company"], F.lit(1995), F.lit(2001)), o, ["company"])


@query("""SELECT r_name AS industry, n_name AS sector, count(DISTINCT o_orderkey) AS documents FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def scope_sector_docs(spark, sf_dir):
    nation, region = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    sectors = F.broadcast(nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("sector"), F.col("r_name").alias("industry")))
    codes = catalog.in_scope(t(spark, sf_dir, "customer"), "sector", sorted(r[0] for r in nation.select("n_nationkey").collect()), "c_custkey", "c_nationkey")
    scoped = t(spark, sf_dir, "customer").join(codes, "c_custkey", "left_semi").join(sectors, F.col("c_nationkey") == F.col("n_nationkey"))
    return scoped.join(t(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("industry", "sector").agg(F.count_distinct("o_orderkey").alias("documents"))


@query("""WITH a AS (SELECT DISTINCT regexp_replace(lower(p_brand), '[^0-9a-z]+', '', 'g') AS alias, p_partkey AS code FROM part),
n AS (SELECT alias, count(DISTINCT code) AS n, min(code) AS code FROM a GROUP BY 1), v AS (SELECT DISTINCT p_brand AS value FROM part UNION SELECT 'nobody')
SELECT value, CASE WHEN n = 1 THEN code END AS code, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status
FROM v LEFT JOIN n ON alias = regexp_replace(lower(value), '[^0-9a-z]+', '', 'g')""")
def alias_ambiguous(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    asked = part.select(F.col("p_brand").alias("value")).union(spark.createDataFrame([("nobody",)], "value string")).distinct()
    return catalog.resolve_direct(asked, catalog.aliases(part, "p_partkey", ["p_brand"]))


@query("""SELECT o_orderkey AS doc_id, p.period FROM orders, (VALUES ('1996-Q2', 19960401, 19960630), ('1997', 19970101, 19971231), ('1998-H2', 19980701, 19981231), ('1999-02-28', 19990228, 19990228)) p(period, lo, hi)
WHERE year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) BETWEEN lo AND hi""")
def period_filter_quarter(spark, sf_dir):
    lower, upper = D.period_bounds(F.col("period"))
    periods = spark.createDataFrame([("1996-Q2",), ("1997",), ("1998-H2",), ("1999-02-28",)], "period string").select("period", lower.alias("lower"), upper.alias("upper"))
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), D.key_of(F.to_date("o_orderdate")).alias("key"))
    return orders.join(F.broadcast(periods), F.col("key").between(F.col("lower"), F.col("upper"))).select("doc_id", "period")


@query("""WITH d AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_shipdate END AS e, o_orderdate AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT l_returnflag, CASE WHEN e IS NOT NULL THEN 'event_date' ELSE 'rcept_dt' END AS basis, year(coalesce(e, r)) AS year FROM d)
SELECT basis, year::INT AS year, l_returnflag, count(*) AS documents FROM k GROUP BY ALL""")
def date_basis_fallback(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    event = F.when(F.col("l_linenumber") % 3 != 0, D.key_of(F.to_date("l_shipdate")))
    received = D.key_of(F.to_date("o_orderdate"))
    basis = D.effective_basis(event, received, F.lit("event_date"))
    key = F.when(basis == "event_date", event).otherwise(received)
    return rows.select(basis.alias("basis"), F.floor(key / 10000).cast("int").alias("year"), "l_returnflag").groupBy("basis", "year", "l_returnflag").agg(F.count("*").alias("documents"))


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = t(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(F.sum(money("o_totalprice")).cast("double").alias("revenue"))


_YEARLY = "y AS (SELECT c_nationkey AS nation, year(o_orderdate)::INT AS year, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS revenue FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


@query(f"""WITH {_YEARLY} SELECT nation, year, revenue, lag(revenue) OVER w AS previous, round(revenue - lag(revenue) OVER w, 2) AS change,
round((revenue - lag(revenue) OVER w) / nullif(lag(revenue) OVER w, 0) * 100, 6) AS change_pct FROM y WINDOW w AS (PARTITION BY nation ORDER BY year)""")
def percent_change_yoy(spark, sf_dir):
    out = calc.period_changes(_yearly(spark, sf_dir), ["nation"], "year", "revenue")
    return out.withColumn("change", F.round("change", 2)).withColumn("change_pct", F.round("change_pct", 6))


@query(f"""WITH {_YEARLY}, e AS (SELECT nation, arg_min(revenue, year) AS s, arg_max(revenue, year) AS e, max(year) - min(year) AS n FROM y GROUP BY 1)
SELECT nation, CASE WHEN s > 0 AND e >= 0 AND n > 0 THEN round((pow(e / s, 1.0::DOUBLE / n) - 1) * 100, 6) END AS cagr FROM e""")
def cagr_nation(spark, sf_dir):
    ends = _yearly(spark, sf_dir).groupBy("nation").agg(F.min_by("revenue", "year").alias("s"), F.max_by("revenue", "year").alias("e"), (F.max("year") - F.min("year")).alias("n"))
    return ends.select("nation", F.round(N.cagr(F.col("s"), F.col("e"), F.col("n")), 6).alias("cagr"))


@query(f"WITH {_YEARLY} SELECT nation, year, round(revenue / nullif(sum(revenue) OVER (PARTITION BY year), 0) * 100, 6) AS share_pct FROM y")
def share_of_total(spark, sf_dir):
    out = calc.composition_shares(_yearly(spark, sf_dir), ["year"], "revenue")
    return out.select("nation", "year", F.round("share_pct", 6).alias("share_pct"))


@query("SELECT p_partkey, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)::INT AS rank FROM part")
def rank_ties(spark, sf_dir):
    return calc.competition_rank(t(spark, sf_dir, "part"), ["p_brand"], "p_size").select("p_partkey", "p_size", "rank")


@query("""WITH b AS (SELECT p_brand, max(p_size) AS p_size FROM part GROUP BY 1)
SELECT p_brand, p_size, list(DISTINCT p_partkey ORDER BY p_partkey) AS keys, count(DISTINCT p_partkey) > 1 AS is_tie FROM part JOIN b USING (p_brand, p_size) GROUP BY ALL""")
def argmax_ties(spark, sf_dir):
    return calc.extremes(t(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_size")


@query("SELECT o_custkey, o_orderkey, sum(o_totalprice::DECIMAL(18,4)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM orders")
def running_total(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("price", money("o_totalprice"))
    return calc.cumulative_sum(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "price").select("o_custkey", "o_orderkey", F.col("running").cast("double").alias("running"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS total, round(avg(l_quantity::DECIMAL(18,4)), 6) AS mean_qty, median(l_extendedprice) AS mid,
round(sum(l_extendedprice::DECIMAL(18,4) * l_quantity::DECIMAL(18,4))::DOUBLE / nullif(sum(l_quantity::DECIMAL(18,4))::DOUBLE, 0), 4) AS weighted FROM lineitem GROUP BY ALL""")
def group_aggregates(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", money("l_extendedprice").alias("p"), money("l_quantity").alias("q"), F.col("l_extendedprice").alias("x"))
    weighted = F.try_divide(F.sum(F.col("p") * F.col("q")).cast("double"), F.sum("q").cast("double"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("p").cast("double").alias("total"), F.round(F.avg("q").cast("double"), 6).alias("mean_qty"), F.median("x").alias("mid"), F.round(weighted, 4).alias("weighted"))


@query("SELECT o_orderkey, o_totalprice / 1e4 AS in_man, o_totalprice / 1e8 AS in_eok, NULL::DOUBLE AS unknown FROM orders WHERE o_totalprice IS NOT NULL")
def unit_convert(spark, sf_dir):
    price = F.col("o_totalprice")
    return t(spark, sf_dir, "orders").where(price.isNotNull()).select("o_orderkey", N.convert_krw(price, F.lit("원"), F.lit("만원")).alias("in_man"), N.convert_krw(price, F.lit("원"), F.lit("억원")).alias("in_eok"), N.convert_krw(price, F.lit("원"), F.lit("?")).alias("unknown"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal <> 0 THEN round((s_nationkey - s_acctbal) / s_acctbal * 100, 6) END AS result, s_acctbal <> 0 AS success,
CASE WHEN s_acctbal = 0 THEN 'undefined for these inputs' END AS error FROM supplier""")
def safe_dispatch(spark, sf_dir):
    out = calc.evaluate(t(spark, sf_dir, "supplier"), "percent_change", ["s_nationkey", "s_acctbal"])
    return out.select("s_suppkey", F.round("result", 6).alias("result"), "success", "error")


@query("""SELECT n_nationkey, s AS suppliers, c AS customers, s - c AS difference, abs(s - c) AS absolute_difference, CASE WHEN s > c THEN 'suppliers' WHEN c > s THEN 'customers' END AS larger, CASE WHEN s < c THEN 'suppliers' WHEN c < s THEN 'customers' END AS smaller
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def compare_two(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    both = t(spark, sf_dir, "nation").select("n_nationkey").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    return calc.compare_two(both, "suppliers", "customers")


@query("""SELECT o_custkey, count(*) FILTER (year(o_orderdate) = 1996) AS y1996, count(*) FILTER (year(o_orderdate) = 1997) AS y1997, count(*) FILTER (year(o_orderdate) = 1998) AS y1998,
count(*) FILTER (year(o_orderdate) = 1996) > 0 AND count(*) FILTER (year(o_orderdate) = 1997) > 0 AND count(*) FILTER (year(o_orderdate) = 1998) > 0 AS complete FROM orders GROUP BY 1""")
def coverage_pivot(spark, sf_dir):
    return catalog.coverage_pivot(t(spark, sf_dir, "orders"), "o_custkey", F.year("o_orderdate"), [1996, 1997, 1998])


@query("SELECT conv_id, count(*) AS members FROM conversations GROUP BY 1 HAVING count(*) >= 2")
def chain_counts(spark, sf_dir):
    return catalog.chain_counts(t(spark, sf_dir, "conversations"), "conv_id")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS company FROM orders WHERE year(o_orderdate) <= 1996), b AS (SELECT DISTINCT o_custkey AS company FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT company, 'left' AS side FROM a WHERE company NOT IN (SELECT company FROM b) UNION ALL SELECT company, 'right' FROM b WHERE company NOT IN (SELECT company FROM a)""")
def anti_join_audit(spark, sf_dir):
    """Companies with early orders and those with urgent ones: keys of either side alone."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), "o_orderdate", "o_orderpriority")
    return catalog.one_sided(o.where(F.year("o_orderdate") <= 1996).select("company"), o.where("o_orderpriority = '1-URGENT'").select("company"), "company")


@query(r"""WITH k AS (SELECT doc_id, row_number() OVER (PARTITION BY sha1(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'))) ORDER BY doc_id) AS n FROM documents) SELECT doc_id FROM k WHERE n = 1""")
def chunk_dedupe_sha1(spark, sf_dir):
    return retrieval.first_of_content(t(spark, sf_dir, "documents"), [], "text", [F.col("doc_id")]).select("doc_id")


@query("""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no_text' WHEN length(trim(text)) < 10 THEN 'too_short' WHEN trim(coalesce(source, '')) = '' THEN 'no_field_1' WHEN trim(coalesce(lang, '')) = '' THEN 'no_field_2' ELSE 'ok' END AS reason FROM documents""")
def chunk_validity(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", chunking.chunk_reason(F.col("doc_id"), F.col("text"), F.col("source"), F.col("lang")).alias("reason"))


@query("""SELECT l_orderkey, count(DISTINCT l_linenumber) AS parts, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AS complete FROM lineitem GROUP BY 1""")
def part_sequence_qa(spark, sf_dir):
    return calc.part_sequences(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(r"""SELECT doc_id, list_sort(list_distinct([regexp_replace(x, '[,\s]', '', 'g') for x in regexp_extract_all(text, '(\d[\d,]*(?:\.\d+)?(?:\s*%)?)', 1)])) AS numbers FROM documents""")
def numeric_tokens(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_sort(N.number_tokens(F.col("text"))).alias("numbers"))


@query(r"""WITH n AS (SELECT conv_id, turn, list_distinct([regexp_replace(x, '[,\s%]', '', 'g') for x in regexp_extract_all(text, '(\d[\d,]*(?:\.\d+)?(?:\s*%)?)', 1)]) AS own FROM conversations)
SELECT a.conv_id, a.turn, list_sort([x for x in a.own if NOT list_contains(coalesce(b.own, []), x) AND length(x) > 1 AND NOT regexp_full_match(x, '19\d\d|20\d\d|2100')]) AS unsupported
FROM n a LEFT JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def evidence_unsupported(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    joined = c.join(before, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", F.array_sort(grounding.unsupported_numbers(F.col("text"), F.col("evidence"))).alias("unsupported"))


_TERMS = ("the", "idiot", "token", "que")


@query("""SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'idiot')::INT + contains(lower(text), 'token')::INT + contains(lower(text), 'que')::INT) / 4.0::DOUBLE AS coverage FROM documents""")
def term_coverage(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", grounding.term_coverage(F.col("text"), F.array(*[F.lit(x) for x in _TERMS])).alias("coverage"))


@query("""SELECT term, (n_chars // 1000)::BIGINT AS year, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM documents, (VALUES ('the'), ('idiot'), ('token'), ('que')) v(term) WHERE contains(lower(text), term) GROUP BY ALL""")
def term_by_year(spark, sf_dir):
    return retrieval.terms_by_year(t(spark, sf_dir, "documents"), _TERMS, "doc_id", "text", F.floor(F.col("n_chars") / 1000))


@query("""SELECT a.conv_id, a.turn, string_agg(b.text, chr(10) ORDER BY b.turn, b.text) AS context FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY ALL""")
def neighbour_merge(spark, sf_dir):
    return retrieval.with_neighbours(t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "context")


@query("""WITH w AS (SELECT o_custkey, list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS items FROM orders) SELECT * FROM w WHERE len(items) = 3""")
def sliding_groups(spark, sf_dir):
    return calc.sliding_groups(t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", 3)


@query("""WITH w AS (SELECT o_custkey, list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS items FROM orders),
s AS (SELECT o_custkey, list_sort(items) AS ids FROM w WHERE len(items) = 2)
SELECT o_custkey, ids, 'same_company' AS kind, left(sha1('same_company|' || array_to_string(ids, ',')), 12) AS group_id FROM s GROUP BY ALL""")
def comparison_groups(spark, sf_dir):
    return datasets.comparison_groups(t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", 2, "same_company")


@query("""WITH u AS (SELECT doc_id, ('0x' || left(sha256('seed' || doc_id::VARCHAR), 12))::BIGINT / 281474976710655.0::DOUBLE AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM u""")
def hash_split(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", datasets.hash_split(F.col("doc_id"), "seed").alias("split"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey - s_suppkey % 7 + 1 AS b FROM supplier UNION SELECT s_suppkey - s_suppkey % 7 + 1, s_suppkey FROM supplier),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node, min(other) AS component FROM r GROUP BY 1""")
def closure_components(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") - F.col("s_suppkey") % 7 + 1).alias("dst"))
    return catalog.closure(s)


@query()
def sentence_pack(spark, sf_dir):
    return chunking.narrative_chunks(t(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def html_paragraphs(spark, sf_dir):
    return chunking.paragraphs(t(spark, sf_dir, "pages").select("page_id", "html"), "html")


@query("""WITH m AS (SELECT conv_id, turn, role, text, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND lag(turn) OVER w IS NOT NULL THEN 0 ELSE 1 END AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m)
SELECT conv_id, island::BIGINT AS island, role, list(text ORDER BY turn, text) AS texts FROM i GROUP BY conv_id, island, role""")
def note_islands(spark, sf_dir):
    return chunking.islands(t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text")


@query("""SELECT user_id, event_id, event_type, round(value, 6) AS distance, origins FROM (
 SELECT user_id, event_id, any_value(event_type) AS event_type, min(d) AS value, list_sort(list_distinct(list(o))) AS origins FROM (
  SELECT user_id, event_id, event_type, value AS d, 'primary' AS o FROM events UNION ALL SELECT user_id, event_id, event_type, value / 2, 'auxiliary' FROM events) GROUP BY 1, 2)""")
def combined_results(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("value").alias("distance"))
    out = retrieval.combine_results(e, e.withColumn("distance", F.col("distance") / 2), ["user_id", "event_id"])
    return out.select("user_id", "event_id", "event_type", F.round("distance", 6).alias("distance"), "origins")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    return streams.window_totals(t(spark, sf_dir, "events"))


@query(r"""SELECT doc_id, list_sort(list_distinct([x for x in regexp_extract_all(lower(text), '[가-힣a-z0-9%]+') if length(x) >= 2])) AS tokens FROM documents""")
def rerank_tokens(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_sort(X.tokens(F.col("text"))).alias("tokens"))


@query("""SELECT doc_id, CASE WHEN strpos(lower(text), 'the') > 0 THEN substring(text, greatest(strpos(lower(text), 'the') - 180, 1), strpos(lower(text), 'the') + 183 - greatest(strpos(lower(text), 'the') - 180, 1)) ELSE '' END AS snippet FROM documents""")
def snippets(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.snippet("text", "the").alias("snippet"))


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, substring(text, 1, 400) AS cut FROM conversations),
u AS (SELECT *, sum(length(cut)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM r) SELECT conv_id, turn, cut AS text FROM u WHERE n <= 3 AND used <= 1000""")
def source_budget(spark, sf_dir):
    return grounding.within_budget(t(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 400, 1000, 3)


@query("""WITH p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS place FROM conversations)
SELECT conv_id, place // 3 AS bundle, list(turn ORDER BY place) AS ids, left(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY place), 2000) AS context FROM p GROUP BY 1, 2""")
def context_bundles(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations")
    return datasets.bundles(rows, ["conv_id"], ["turn"], "turn", "text", 3, 2000)


@query()
def evidence_line_pick(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "text", N.answer_numbers(F.col("text")).alias("numbers"), F.array(F.lit("token"), F.lit("idiot")).alias("terms"))
    return grounding.evidence_lines(docs, ["doc_id"], "text", "numbers", "terms")


@query("""SELECT source, round(avg(n_chars), 6) AS mean, median(n_chars) AS mid, min(n_chars) AS low, max(n_chars) AS high, count(*) AS n FROM documents GROUP BY 1""")
def describe_by_source(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.median("n_chars").alias("mid"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.count("*").alias("n"))


from . import lookups, more, names  # noqa: E402  register the other queries

__all__ = ["QUERIES", "SQL", "Window", "lookups", "more", "names"]
