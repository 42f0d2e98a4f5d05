"""Further registered queries: text and date functions, requests, calculations, tables, grounding and datasets over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as X
from ..operators import calc, calculation, catalog, coverage, datasets, grounding, requests, retrieval, tables
from .registry import money, query, t

# ---- text


@query(r"""SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS clean, regexp_replace(lower(coalesce(text, '')), '[^0-9a-z가-힣]+', '', 'g') AS match_key,
regexp_replace(lower(coalesce(text, '')), '[\s\-_()/\[\]{}]+', '', 'g') AS dense_key, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS free_key FROM conversations""")
def text_keys(spark, sf_dir):
    c = F.col("text")
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", X.clean(c).alias("clean"), X.match_key(c).alias("match_key"), X.dense_key(c).alias("dense_key"), X.free_key(c).alias("free_key"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), ' *\r?\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS block FROM documents""")
def block_clean(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.clean_block("text").alias("block"))


@query(r"""WITH k AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') AS a, regexp_replace(lower(p_type), '[^0-9a-z]+', '', 'g') AS b, p_name, p_type FROM part)
SELECT p_partkey, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS overlap, trim(p_name) || ' | ' || p_type AS line,
'part_' || regexp_replace(p_name, '[^0-9A-Za-z._-]+', '_', 'g') AS file_name FROM k""")
def name_functions(spark, sf_dir):
    a, b = F.col("p_name"), F.col("p_type")
    return t(spark, sf_dir, "part").select("p_partkey", X.keys_overlap(X.match_key(a), X.match_key(b)).alias("overlap"), X.row_line(F.array(F.trim(a), b)).alias("line"), F.concat(F.lit("part_"), X.safe_file_name(a)).alias("file_name"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, 'x' || l_orderkey || '_table_' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '_part_' || l_linenumber ELSE '' END AS id, 'x' || l_orderkey || '_narrative_' || l_linenumber AS note,
'/raw/' || (20240000000000 + l_orderkey) || '_' || l_linenumber || '.xml' AS path FROM lineitem)
SELECT l_orderkey, l_linenumber, l_linenumber AS table_no, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS part_no, l_linenumber AS narrative_no, (20240000000000 + l_orderkey)::VARCHAR AS receipt FROM c""")
def chunk_id_parts(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    own, n = F.concat(F.lit("x"), F.col("l_orderkey")), F.col("l_linenumber")
    chunk = F.concat(own, F.lit("_table_"), n, F.when(n % 2 == 0, F.concat(F.lit("_part_"), n)).otherwise(""))
    path = F.concat(F.lit("/raw/"), F.lit(20240000000000) + F.col("l_orderkey"), F.lit("_"), n, F.lit(".xml"))
    return l.select("l_orderkey", "l_linenumber", X.table_number(chunk).alias("table_no"), X.part_number(chunk).alias("part_no"), X.narrative_number(F.concat(own, F.lit("_narrative_"), n)).alias("narrative_no"), X.receipt_number(path).alias("receipt"))


@query("""WITH c AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS flags FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string([flags[i] FOR i IN range(1, len(flags) + 1) IF i = 1 OR flags[i] <> flags[i - 1]], ' | ') AS line FROM c""")
def collapsed_cells(spark, sf_dir):
    cells = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("cells"))
    return cells.select("l_orderkey", X.row_line(X.compress_cells(F.col("cells"))).alias("line"))


@query("""WITH c AS (SELECT o_custkey, o_orderstatus AS s, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) SELECT o_custkey, list(s ORDER BY first) AS statuses FROM c GROUP BY 1""")
def ordered_distinct(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("first")).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "o_orderstatus"))), lambda x: F.concat(F.lit(" "), x["o_orderstatus"])).alias("s"))
    return rows.select("o_custkey", X.unique_texts(F.col("s")).alias("statuses"))


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def json_recovered(spark, sf_dir):
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return t(spark, sf_dir, "events").select("event_id", X.json_object(reply, "k int")["k"].alias("k"))


@query("""SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'eleven' WHEN 'Brand#12' THEN 'twelve' ELSE p_brand END AS label,
CASE WHEN contains(p_name, 'cold') THEN 'c' WHEN contains(p_name, 'widget') THEN 'w' ELSE p_name END AS rule, p_name || ' | ' || coalesce(p_type, '') || ' | ' || p_size AS metadata FROM part""")
def mapped_names(spark, sf_dir):
    return t(spark, sf_dir, "part").select(
        "p_partkey", requests.report_label(F.col("p_brand"), {"Brand#11": "eleven", "Brand#12": "twelve"}).alias("label"),
        X.first_rule("p_name", [("cold", "c"), ("widget", "w")]).alias("rule"), X.metadata_text(F.array(F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string"))).alias("metadata"),
    )


# ---- numbers


@query(r"""SELECT doc_id, list_sort(list_distinct([regexp_replace(regexp_replace(regexp_replace(x, ',', '', 'g'), '(\.\d*?)0+$', '\1'), '\.$', '') FOR x IN regexp_extract_all(coalesce(text, ''), '(?:^|[^A-Za-z0-9])(\d[\d,]*(?:\.\d+)?)', 1)])) AS numbers FROM documents""")
def bare_numbers(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_sort(N.bare_numbers(F.col("text"))).alias("numbers"))


@query("""SELECT o_orderkey, [(round(o_totalprice)::BIGINT)::VARCHAR || ' 원', o_custkey::VARCHAR || ' USD'] AS pairs, [(round(o_totalprice)::BIGINT)::VARCHAR] AS answer FROM orders WHERE o_totalprice IS NOT NULL""")
def unit_pairs(spark, sf_dir):
    price = F.round("o_totalprice").cast("long")
    text = F.concat(F.lit("매출 "), F.format_number(price, 0), F.lit("원, USD "), F.col("o_custkey").cast("string"))
    return t(spark, sf_dir, "orders").where("o_totalprice IS NOT NULL").select("o_orderkey", N.number_units(text).alias("pairs"), N.answer_numbers(F.concat(F.format_number(price, 0), F.lit("원"))).alias("answer"))


@query("""SELECT s_suppkey, s_acctbal + s_nationkey AS added, s_acctbal * s_nationkey AS multiplied, s_nationkey / nullif(s_acctbal, 0) AS ratio, s_nationkey / nullif(s_acctbal, 0) * 100 AS share, s_acctbal - s_nationkey AS change FROM supplier""")
def scalar_operations(spark, sf_dir):
    a, b = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    op = calc.SCALAR
    return t(spark, sf_dir, "supplier").select("s_suppkey", op["add"](a, b).alias("added"), op["multiply"](a, b).alias("multiplied"), op["ratio"](b, a).alias("ratio"), op["share"](b, a).alias("share"), op["percentage_point_change"](a, b).alias("change"))


@query("""SELECT s_suppkey, round_even(s_acctbal, 1) AS rounded, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal * 100 ELSE s_acctbal END AS percent FROM supplier""")
def rounding_percent(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", N.half_even(F.col("s_acctbal").cast("decimal(18,4)"), 1).cast("double").alias("rounded"), N.normal_percent(F.col("s_acctbal"), F.col("s_nationkey") % 2 == 0).alias("percent"))


@query("""SELECT o_orderstatus, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total, median(o_totalprice) AS mid, max(o_totalprice) AS high, min(o_totalprice) AS low FROM orders GROUP BY 1""")
def named_aggregates(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderstatus", money("o_totalprice").alias("price"), F.col("o_totalprice").alias("x"))
    out = calc.aggregate(o, ["o_orderstatus"], total=("total", "price"), mid=("median", "x"), high=("max", "x"), low=("min", "x"))
    return out.withColumn("total", F.col("total").cast("double"))


@query("""SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS units, count(DISTINCT o_orderstatus) <= 1 AS same_unit FROM orders GROUP BY 1""")
def unit_agreement(spark, sf_dir):
    return calc.same_unit(t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("""WITH b AS (SELECT p_brand, min(p_size) AS p_size FROM part GROUP BY 1)
SELECT p_brand, p_size, list(DISTINCT p_partkey ORDER BY p_partkey) AS keys, count(DISTINCT p_partkey) > 1 AS is_tie FROM part JOIN b USING (p_brand, p_size) GROUP BY ALL""")
def argmin_ties(spark, sf_dir):
    return calc.extremes(t(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_size", largest=False)


@query("""SELECT c_custkey FROM customer ORDER BY sha256('s:' || c_custkey), c_custkey LIMIT 20""")
def hashed_sample(spark, sf_dir):
    return calc.sample_rows(t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 20, "s")


@query("SELECT column_name AS \"column\", value, count(*) AS n FROM (SELECT 'lang' AS column_name, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY ALL")
def value_counts(spark, sf_dir):
    return tables.value_counts(t(spark, sf_dir, "documents"), ["lang", "source"])


# ---- dates, periods, requests


@query("""WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') AS shown, strftime(o_orderdate, '%Y%m%d')::INT AS k FROM orders)
SELECT o_orderkey, k AS key, k AS again, CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 12 END AS half FROM d""")
def date_keys(spark, sf_dir):
    day = F.to_date("o_orderdate")
    half = F.when(F.col("o_orderkey") % 2 == 0, "h1").otherwise("H2")
    return t(spark, sf_dir, "orders").select("o_orderkey", D.date_key(F.date_format(day, "yyyy.MM.dd")).alias("key"), D.key_of(day).alias("again"), D.half_month(half).alias("half"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate)::VARCHAR WHEN o_orderkey % 3 = 1 THEN (year(o_orderdate) + 1)::VARCHAR ELSE 'unknown' END AS bucket FROM orders""")
def period_buckets(spark, sf_dir):
    key = D.key_of(F.to_date("o_orderdate"))
    basis = F.when(F.col("o_orderkey") % 3 == 0, "rcept_dt").when(F.col("o_orderkey") % 3 == 1, "base_year").otherwise("event_date")
    return t(spark, sf_dir, "orders").select("o_orderkey", requests.period_bucket(basis, F.year("o_orderdate") + 1, key, F.lit(None).cast("int")).alias("bucket"))


@query("""WITH q AS (SELECT o_orderkey, o_orderkey % 6 AS k, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'quarter' WHEN 1 THEN 'half' WHEN 2 THEN 'annual' WHEN 3 THEN CASE WHEN m IN (3, 6, 9, 12) THEN 'month' END WHEN 4 THEN 'annual' END AS kind,
(CASE k WHEN 0 THEN ((m - 1) // 3 + 1) * 3 WHEN 1 THEN 6 WHEN 2 THEN 12 WHEN 3 THEN CASE WHEN m IN (3, 6, 9, 12) THEN m END WHEN 4 THEN 12 END)::INT AS month FROM q""")
def question_intents(spark, sf_dir):
    k, m, y = F.col("o_orderkey") % 6, F.month("o_orderdate"), F.year("o_orderdate")
    text = (
        F.when(k == 0, F.concat(y, F.lit("년 "), F.floor((m - 1) / 3 + 1), F.lit("분기 매출은?"))).when(k == 1, F.concat(y, F.lit("년 상반기 이익"))).when(k == 2, F.lit("연간 매출"))
        .when(k == 3, F.concat(F.lit("매출 "), m, F.lit("월"))).when(k == 4, F.concat(y, F.lit("년 매출"))).otherwise(F.lit("매출은 얼마인가"))
    )
    intent = D.period_intent(text)
    return t(spark, sf_dir, "orders").select("o_orderkey", intent["kind"].alias("kind"), intent["month"].alias("month"))


@query("""WITH d AS (SELECT o_orderkey, ['annual_report', 'quarterly_report', 'major'][(o_orderkey % 3 + 1)::INT] AS report, month(o_orderdate) AS m FROM orders)
SELECT o_orderkey, report = 'major' OR (report = 'quarterly_report' AND m = 9) AS kept FROM d""")
def intent_filter(spark, sf_dir):
    report = F.element_at(F.array(F.lit("annual_report"), F.lit("quarterly_report"), F.lit("major")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t(spark, sf_dir, "orders").select("o_orderkey", requests.matches_intent(report, F.month("o_orderdate"), D.period_intent(F.lit("3분기"))).alias("kept"))


@query("""WITH d AS (SELECT o_orderkey, o_custkey, year(o_orderdate)::VARCHAR AS year, ['annual_report', 'major'][(o_orderkey % 2 + 1)::INT] AS report FROM orders),
m AS (SELECT DISTINCT o_custkey, year(o_orderdate)::VARCHAR AS year FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey FROM d SEMI JOIN m USING (o_custkey, year) WHERE report = 'annual_report'""")
def fallback_documents(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("string")).withColumn("report", F.element_at(F.array(F.lit("annual_report"), F.lit("major")), (F.col("o_orderkey") % 2 + 1).cast("int")))
    return requests.fallback_documents(o, o.where("o_orderstatus = 'P'").select("o_custkey", "year"), "o_custkey", "year", "report").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def metadata_filtered(spark, sf_dir):
    found = requests.metadata_filter(t(spark, sf_dir, "orders"), o_orderstatus="O", o_custkey=None)
    return found.where(requests.value_filter(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])).select("o_orderkey")


@query("""SELECT o_orderkey, k < 3 AS supported, CASE WHEN k < 2 THEN year(o_orderdate) END::INT AS base_year, CASE k WHEN 0 THEN quarter(o_orderdate) * 3 WHEN 1 THEN CASE WHEN month(o_orderdate) < 7 THEN 6 ELSE 12 END END::INT AS base_month
FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""")
def time_requests(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    kind = F.when(k < 2, "point").when(k == 2, "").otherwise("range")
    got = requests.time_request(kind, F.year("o_orderdate"), F.when(k == 0, F.quarter("o_orderdate")), F.when(F.month("o_orderdate") < 7, 1).otherwise(2))
    return t(spark, sf_dir, "orders").select("o_orderkey", got.alias("g")).select("o_orderkey", "g.supported", "g.base_year", "g.base_month")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'periodic' WHEN 1 THEN 'exchange' END AS doc_group,
CASE o_orderkey % 3 WHEN 0 THEN 'annual_report' WHEN 1 THEN 'quarterly_report' ELSE 'other' END AS report FROM orders""")
def document_groups(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    kinds = F.when(k == 0, F.array(F.lit("사업보고서"), F.lit("분기보고서"))).when(k == 1, F.array(F.lit("krx"))).when(k == 2, F.array(F.lit("krx"), F.lit("major"))).otherwise(F.array(F.lit("?")))
    m = F.col("o_orderkey") % 3
    report = requests.report_type(F.when(m == 0, " 사업보고서 ").otherwise("other"), F.when(m == 1, "quarterly").otherwise("x"))
    return t(spark, sf_dir, "orders").select("o_orderkey", requests.document_group(kinds).alias("doc_group"), report.alias("report"))


@query("""SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN ['point', 'range'][(k + 1)::INT] ELSE 'unknown' END AS time_type, CASE WHEN k <> 2 THEN year(o_orderdate) END::INT AS start_year,
CASE WHEN k = 0 THEN 'H1' END AS start_half, [x FOR x IN [CASE WHEN o_custkey % 2 = 1 THEN 'scope' END, CASE WHEN k <> 0 THEN 'time' END, CASE WHEN o_custkey % 3 = 0 THEN 'topic' END] IF x IS NOT NULL] AS missing
FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""")
def slot_check(spark, sf_dir):
    k, text = F.col("o_orderkey") % 4, lambda c: c.cast("string")
    half = F.when(k == 0, "상반기").otherwise("?")
    point = F.struct(F.when(k != 2, text(F.year("o_orderdate"))).alias("year"), F.lit("9").alias("quarter"), half.alias("half"))
    nothing = F.struct(F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("quarter"), F.lit(None).cast("string").alias("half"))
    body = F.struct(F.when(k == 0, " Point ").when(k == 1, "range").when(k == 2, "point").otherwise("later").alias("type"), point.alias("start"), nothing.alias("end"))
    time = requests.time_slots(body)
    scope = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("A회사"))).otherwise(F.array().cast("array<string>"))
    topics = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("2024년 1분기"), F.lit(" "))).otherwise(F.array(F.lit("매출")))
    missing = requests.missing_slots(F.lit("direct"), scope, time, F.array().cast("array<string>"), topics)
    return t(spark, sf_dir, "orders").select("o_orderkey", time["time_type"].alias("time_type"), time["start_year"].alias("start_year"), time["start_half"].alias("start_half"), missing.alias("missing"))


@query("""WITH w AS (SELECT DISTINCT conv_id, lower(x) AS k FROM conversations, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) u(x)),
p AS (SELECT DISTINCT lower(x) AS k FROM part, unnest(string_split(p_name, ' ')) u(x)), f AS (SELECT conv_id, min(k) AS k FROM w WHERE k IN (SELECT k FROM p UNION SELECT 'that' UNION SELECT 'with') GROUP BY conv_id, k)
SELECT conv_id, list(k ORDER BY k) AS keywords FROM f WHERE k <> 'with' GROUP BY 1""")
def grounded_keywords(spark, sf_dir):
    found = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower)))
    asked = t(spark, sf_dir, "conversations").select("conv_id", found.alias("keyword")).withColumn("position", F.col("keyword"))
    names = t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("keyword")).distinct()
    pool = names.union(spark.createDataFrame([("that",), ("with",)], "keyword string")).withColumn("position", F.lit(0))
    return requests.grounded_keywords(asked, pool, spark.createDataFrame([("With",)], "keyword string"), ["zz"], ["conv_id"])


@query("""SELECT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS alias, min(p_partkey) AS code FROM part GROUP BY 1""")
def first_aliases(spark, sf_dir):
    return requests.first_aliases(t(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_partkey")


@query("""SELECT left(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 2) AS prefix, count(DISTINCT p_name) AS members FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1""")
def ambiguous_families(spark, sf_dir):
    return requests.ambiguous_families(t(spark, sf_dir, "part"), "p_name", "p_name")


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), h AS (SELECT p_partkey, n.p_name AS name, row_number() OVER (PARTITION BY p_partkey ORDER BY length(replace(n.p_name, ' ', '')) DESC, n.p_name) AS k
FROM part JOIN n ON contains(regexp_replace(lower('is ' || part.p_name || ' in ' || part.p_type), '[^0-9a-z]+', '', 'g'), regexp_replace(lower(n.p_name), '[^0-9a-z]+', '', 'g')))
SELECT p_partkey, name AS code, name FROM h WHERE k = 1""")
def longest_mention(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    asked = part.select("p_partkey", F.concat(F.lit("is "), F.col("p_name"), F.lit(" in "), F.col("p_type")).alias("question"))
    return requests.longest_mention(asked, part.select("p_name").distinct(), "p_partkey", "question", "p_name", "p_name")


@query("""SELECT o_orderkey FROM orders WHERE year(o_orderdate) < 1996 OR year(o_orderdate) > 1997""")
def outside_window(spark, sf_dir):
    return requests.outside_window(t(spark, sf_dir, "orders").withColumn("key", D.key_of(F.to_date("o_orderdate"))), F.col("key"), 19960101, 19971231).select("o_orderkey")


@query("SELECT page_id, starts_with(lower(url), 'list_') AS is_index FROM pages")
def index_records(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", requests.is_index_record(F.col("url")).alias("is_index"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'request_id' WHEN o_orderkey % 5 = 0 THEN 'report_types' WHEN o_orderkey % 3 = 0 THEN 'unknown_report_type' WHEN o_orderkey % 2 = 0 THEN 'period' END AS error FROM p""")
def plan_errors(spark, sf_dir):
    from pyspark.sql import Window

    key, n = F.col("o_orderkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"))
    name = F.when(key % 7 == 0, "request_1").otherwise(F.concat(F.lit("request_"), F.lpad(F.col("n").cast("string"), 3, "0")))
    kinds = F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 3 == 0, F.array(F.lit("?"))).otherwise(F.array(F.lit("annual_report")))
    lower, upper = D.period_bounds(F.when(key % 2 == 0, "1996-13-01").otherwise("1996-Q1"))
    return rows.select("o_orderkey", requests.plan_error(name, F.col("n"), kinds, lower, upper, D.PERIODIC).alias("error"))


# ---- catalogue and joins


@query("""SELECT o_orderkey, c_name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE c_mktsegment END AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def enriched_records(spark, sf_dir):
    records = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("segment"))
    manifest = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", F.col("c_mktsegment").alias("segment"))
    return catalog.enrich(records, manifest, "key").select("o_orderkey", "c_name", "segment")


@query("""WITH r AS (SELECT DISTINCT o_custkey AS request, o_orderkey AS doc, 'asked' AS why FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT DISTINCT o_custkey AS request, o_orderkey AS doc, 'periodic' AS why FROM orders WHERE o_orderkey % 2 = 0)
SELECT request, doc, CASE WHEN max((why = 'asked')::INT) = 1 THEN 'asked' ELSE 'periodic' END AS why FROM (SELECT * FROM r UNION ALL SELECT * FROM p) GROUP BY ALL""")
def requested_and_periodic(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("doc"), "o_orderstatus")
    asked = o.where("o_orderstatus = 'F'").select("request", "doc", F.lit("asked").alias("why"))
    return catalog.with_periodic(asked, o.where("doc % 2 = 0").select("request", "doc", F.lit("periodic").alias("why")), "request", "doc")


@query("""SELECT o.o_orderkey, q.o_custkey AS request FROM orders o JOIN (SELECT o_custkey, min(strftime(o_orderdate, '%Y%m%d')::INT) AS lo FROM orders GROUP BY 1) q ON o.o_custkey = q.o_custkey
WHERE strftime(o.o_orderdate, '%Y%m%d')::INT BETWEEN lo AND lo + 10000""")
def request_documents(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", D.key_of(F.to_date("o_orderdate")).alias("key"))
    asked = o.groupBy("o_custkey").agg(F.min("key").alias("lower")).select("o_custkey", F.col("o_custkey").alias("request"), "lower", (F.col("lower") + 10000).alias("upper"))
    return catalog.documents_in_period(o, asked, ["o_custkey"], "key").select("o_orderkey", "request")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey - s_suppkey % 7 + 1 AS b FROM supplier UNION SELECT s_suppkey - s_suppkey % 7 + 1, s_suppkey FROM supplier),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other), c AS (SELECT node, min(other) AS k FROM r GROUP BY 1)
SELECT DISTINCT s.s_nationkey AS request, b.node AS doc FROM supplier s JOIN c a ON a.node = s.s_suppkey JOIN c b ON a.k = b.k WHERE s.s_suppkey % 5 = 0""")
def chain_expansion(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    edges = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") - F.col("s_suppkey") % 7 + 1).alias("dst"))
    seeds = s.where("s_suppkey % 5 = 0").select(F.col("s_nationkey").alias("request"), F.col("s_suppkey").alias("doc"))
    return catalog.expand_seeds(seeds, edges, "doc").select("request", "doc")


@query("""WITH v AS (SELECT DISTINCT p_brand AS value FROM part UNION ALL SELECT 'old widget' UNION ALL SELECT 'nobody'), n AS (SELECT DISTINCT p_name AS code, regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') AS alias FROM part),
k AS (SELECT value, replace(lower(value), ' ', '') AS key FROM v)
SELECT value, code, 'exact' AS matched FROM k JOIN n ON key = alias UNION ALL SELECT value, code, CASE WHEN code IS NOT NULL THEN 'part' END FROM (SELECT * FROM k WHERE key NOT IN (SELECT alias FROM n)) LEFT JOIN n ON contains(alias, key)""")
def alias_contains(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    asked = part.select(F.col("p_brand").alias("value")).distinct().union(spark.createDataFrame([("old widget",), ("nobody",)], "value string"))
    names = part.select(X.match_key("p_name").alias("alias"), F.col("p_name").alias("code")).distinct()
    return catalog.resolve_contains(asked, names)


# ---- retrieval


@query("""WITH q AS (SELECT vec_id // 50 AS request_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0), k AS (SELECT r.request_id, n.n AS keyword_no, e.embedding AS qv FROM q r, (VALUES (1), (2)) n(n) JOIN embeddings e ON e.vec_id = r.request_id * 50 + n.n),
a AS (SELECT 'query_dense' AS channel, request_id, label AS doc_group, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS score, 24 AS most FROM embeddings, q
 UNION ALL SELECT 'keyword_dense:' || keyword_no, request_id, label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6), 12 FROM embeddings, k),
p AS (SELECT *, row_number() OVER (PARTITION BY channel, request_id, doc_group ORDER BY score DESC, chunk_id) AS rank FROM a)
SELECT request_id AS question_id, request_id, doc_group, chunk_id, score, rank::INT AS rank, channel FROM p WHERE rank <= most""")
def candidate_groups(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    request = (F.col("vec_id") / 50).cast("long")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_group"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 50 = 0").select(request.alias("question_id"), request.alias("request_id"), F.col("embedding").alias("query_vector"))
    words = e.where("vec_id % 50 IN (1, 2)").select(request.alias("question_id"), request.alias("request_id"), (F.col("vec_id") % 50).cast("int").alias("keyword_no"), F.col("embedding").alias("query_vector"))
    return retrieval.candidates(chunks, asked, words, ["doc_group"])


@query("""WITH r AS (SELECT l_orderkey AS question_id, l_linenumber % 2 AS request_id, l_suppkey % 3 AS doc_id, l_partkey AS chunk_id, CASE WHEN l_linenumber % 3 = 0 THEN 'a' ELSE 'b' END AS channel, l_linenumber AS rank, l_returnflag AS text FROM lineitem),
m AS (SELECT *, min(chunk_id) OVER (PARTITION BY question_id, doc_id, text) AS first FROM r), b AS (SELECT question_id, request_id, first, channel, min(rank) AS rank FROM m GROUP BY ALL),
s AS (SELECT question_id, request_id, first, sum(1.0::DOUBLE / (60 + rank)) AS f FROM b GROUP BY ALL) SELECT question_id, first AS chunk_id, list(request_id ORDER BY request_id) AS requests, round(max(f), 9) AS fusion FROM s GROUP BY question_id, first""")
def fuse_merged(spark, sf_dir):
    n = F.col("l_linenumber")
    found = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), (n % 2).alias("request_id"), (F.col("l_suppkey") % 3).alias("doc_id"), F.col("l_partkey").alias("chunk_id"), F.when(n % 3 == 0, "a").otherwise("b").alias("channel"), n.alias("rank"), F.concat(F.lit(" "), F.col("l_returnflag"), F.lit("\n")).alias("text"))
    return retrieval.fuse_merged(found).withColumn("fusion", F.round("fusion", 9))


@query("""WITH k AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(lower(coalesce(text, '')), '[\\s\\-_()/\\[\\]{}]+', '', 'g') AS k, (doc_id % 13)::DOUBLE / 10 AS d FROM documents),
p AS (SELECT *, ((contains(k, 'the'))::INT + (contains(k, 'que'))::INT)::DOUBLE / 2 AS topics, ((contains(k, 'the'))::INT + (contains(k, 'eau'))::INT + (contains(k, 'zzz'))::INT)::DOUBLE / 3 AS asked,
 (0.5 * contains(text, '|')::INT + 0.3 * regexp_matches(text, '\\d')::INT + 0.2 * regexp_matches(text, '백만원|억원|천원|원|%|명|주')::INT)::DOUBLE AS evidence FROM k)
SELECT doc_id, round((0.6::DOUBLE * greatest(0, least(1, 1 - d)) + 0.25::DOUBLE * least(1.0, 0.8::DOUBLE * topics + 0.2::DOUBLE * asked) + 0.15::DOUBLE * contains(k, 'idiot')::INT + 0.05::DOUBLE * evidence) / 1.05::DOUBLE, 6) AS score FROM p""")
def hybrid_scores(spark, sf_dir):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    distance = (F.col("doc_id") % 13).cast("double") / 10
    score = retrieval.hybrid_score(distance, F.coalesce("text", F.lit("")), words("the", "que"), words("idiot"), F.lit("the Eau, the zzz x"))
    return t(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 1 THEN greatest(o_totalprice, o_custkey) ELSE 0 END AS score FROM orders WHERE o_totalprice IS NOT NULL""")
def channel_scores(spark, sf_dir):
    k, price, other = F.col("o_orderkey") % 3, F.col("o_totalprice"), F.col("o_custkey").cast("double")
    scores = F.when(k == 0, F.create_map(F.lit("r1:a"), price, F.lit("r2:a"), price + 1)).when(k == 1, F.create_map(F.lit("r3:a"), price, F.lit("r2:a"), other)).otherwise(F.create_map().cast("map<string,double>"))
    return t(spark, sf_dir, "orders").where("o_totalprice IS NOT NULL").select("o_orderkey", retrieval.channel_score(scores, F.lit("r1")).alias("score"))


@query("""SELECT doc_id, coalesce(text, '') || chr(10) || concat_ws(' ', lang, source) AS searchable FROM documents""")
def searchable_texts(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", retrieval.searchable_text(F.col("text"), [F.col("lang"), F.col("source")]).alias("searchable"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 2) DESC, event_id) AS g FROM events) SELECT user_id, event_id, g::INT AS global_rank FROM p WHERE g <= 5""")
def merged_ranks(spark, sf_dir):
    found = t(spark, sf_dir, "events").select("user_id", "event_id", F.round("value", 2).alias("score"))
    return retrieval.merged_ranks(found, ["user_id"], 5, "event_id").select("user_id", "event_id", "global_rank")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderpriority, o_orderkey FROM p WHERE n = 1""")
def first_sources(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("none", F.lit(None).cast("string"))
    return retrieval.first_source(o, "o_custkey", ["none", "o_orderpriority"], "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, 100 * (l_returnflag = 'R')::INT + 10 * l_discount + greatest(0.0::DOUBLE, 5 - 0.1::DOUBLE * l_linenumber) AS s FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber) AS n FROM s)
SELECT l_orderkey, round(s, 6) AS evidence_score FROM p WHERE n = 1""")
def best_chunk_per_document(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    out = retrieval.best_per_document(l, ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_discount"), F.col("l_linenumber"), "l_linenumber")
    return out.select("l_orderkey", F.round("evidence_score", 6).alias("evidence_score"))


_LINE = "'Lines of order number ' || l_orderkey || ', all amounts in thousands: ' || l_returnflag || ' ' || l_quantity::INT || ' of part ' || l_partkey"


@query(f"""WITH parts AS (SELECT 'turns' AS kind, conv_id AS id, turn AS part, turn AS score, coalesce(text, '') AS text, 1500 AS most FROM conversations UNION ALL SELECT 'lines', l_orderkey, l_linenumber, l_linenumber, {_LINE}, 150 FROM lineitem),
t AS (SELECT kind, id, most, list(left(text, 400) ORDER BY part, text) AS heads, list(text ORDER BY part, text) AS texts, max(score) AS score, count(*) AS parts FROM parts GROUP BY 1, 2, 3),
h AS (SELECT *, list_max(list_filter(range(0, length(heads[1]) + 1), lambda n: len(list_distinct(list_transform(heads, lambda x: left(x, n)))) = 1 AND list_min(list_transform(heads, lambda x: length(x))) >= n)) AS n FROM t),
l AS (SELECT *, CASE WHEN len(list_distinct(heads)) = 1 THEN heads[1] ELSE regexp_extract(left(heads[1], n), '(?s)^(.*[[:space:]])', 1) END AS lead FROM h),
c AS (SELECT *, CASE WHEN parts > 1 AND length(lead) >= 20 THEN length(lead) ELSE 0 END AS drop FROM l),
j AS (SELECT *, texts[1] || CASE WHEN parts > 1 THEN chr(10) || array_to_string(list_transform(texts[2:], lambda x: substring(x, drop + 1)), chr(10)) ELSE '' END AS joined FROM c)
SELECT kind, id, CASE WHEN length(joined) > most THEN left(joined, most) || chr(10) || '…' ELSE joined END AS text, score, parts FROM j""")
def merged_tables(spark, sf_dir):
    turns = t(spark, sf_dir, "conversations").select(F.lit("turns").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text", F.col("turn").alias("score"))
    text = F.concat(F.lit("Lines of order number "), "l_orderkey", F.lit(", all amounts in thousands: "), "l_returnflag", F.lit(" "), F.col("l_quantity").cast("int"), F.lit(" of part "), "l_partkey")
    lines = t(spark, sf_dir, "lineitem").select(F.lit("lines").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("part"), text.alias("text"), F.col("l_linenumber").cast("long").alias("score"))
    merged = [retrieval.merge_tables(rows, ["kind", "id"], "part", "text", "score", most) for rows, most in ((turns, 1500), (lines, 150))]
    return merged[0].unionByName(merged[1])


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'no_document' WHEN 1 THEN 'insufficient_relevance' WHEN 2 THEN 'no_chunk_selected' WHEN 3 THEN 'partial' ELSE 'covered' END AS status FROM orders""")
def coverage_status(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    number = lambda cond: F.when(cond, 0).otherwise(2)
    return t(spark, sf_dir, "orders").select("o_orderkey", coverage.status(number(k == 0), number(k <= 1), number(k <= 2), F.lit(2), F.when(k == 3, 1).otherwise(2)).alias("status"))


# ---- tables and chunks

_KIND_WORDS = [w for _, words in tables.TABLE_KINDS for w in words]
_LISTED = "[" + ", ".join(f"'{w}'" for w in _KIND_WORDS) + ", 'plain', '목차', '-----']"
_KIND_CASE = " ".join(f"WHEN regexp_matches(title || chr(10) || body, '{'|'.join(words)}') THEN '{kind}'" for kind, words in tables.TABLE_KINDS)
_PART_TEXT = ("p_name", "p_brand", "p_type")


@query(f"""WITH w AS (SELECT *, {_LISTED} AS words FROM part), k AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN words[p_partkey // 4 % len(words) + 1] ELSE p_type END AS title,
 CASE WHEN p_partkey % 5 = 0 THEN '-----' || chr(10) || '------ | -------' ELSE words[p_partkey % len(words) + 1] || ' | ' || p_size || CASE WHEN p_size % 2 = 0 THEN ' | ' || round(p_retailprice)::BIGINT || ' | 7,1' ELSE '' END || repeat(' x', p_size) END AS body FROM w),
n AS (SELECT *, CASE {_KIND_CASE} ELSE 'general_table' END AS kind FROM k)
SELECT p_partkey, kind, CASE kind WHEN 'financial_table' THEN 'high' WHEN 'business_table' THEN 'high' WHEN 'governance_table' THEN 'medium' WHEN 'document_admin' THEN 'low' ELSE
 CASE WHEN len(regexp_extract_all(body, '\\d[\\d,.]*')) >= 3 THEN 'medium' WHEN length(body) < 80 OR trim(title) IN ('목 차', '목차') THEN 'low' ELSE 'medium' END END AS priority,
p_size >= 2 AND length(body) >= 10 AND trim(title) NOT IN ('목 차', '목차') AND len(regexp_extract_all(body, '-{{5,}}')) < 3 AND length(regexp_replace(body, '[-|\\s]', '', 'g')) >= 5 AS searchable FROM n""")
def table_classes(spark, sf_dir):
    """Titles and bodies that hold each word of every kind, contents lists, rules and numbers."""
    from ..operators.chunking import search_priority

    words, key, size = F.array(*[F.lit(w) for w in [*_KIND_WORDS, "plain", "목차", "-----"]]), F.col("p_partkey"), F.col("p_size")
    title = F.when(key % 4 == 0, F.get(words, (F.floor(key / 4) % F.size(words)).cast("int"))).otherwise(F.col("p_type"))
    numbers = F.when(size % 2 == 0, F.concat(F.lit(" | "), F.round("p_retailprice").cast("long"), F.lit(" | 7,1"))).otherwise("")
    body = F.when(key % 5 == 0, F.lit("-----\n------ | -------")).otherwise(F.concat(F.get(words, (key % F.size(words)).cast("int")), F.lit(" | "), size, numbers, F.repeat(F.lit(" x"), size)))
    rows = t(spark, sf_dir, "part").select("p_partkey", "p_size", title.alias("title"), body.alias("body")).withColumn("kind", tables.table_kind(F.col("title"), F.col("body")))
    return rows.select("p_partkey", "kind", search_priority(F.col("body"), F.col("kind"), F.col("title")).alias("priority"), tables.searchable_table(F.col("title"), size, F.col("body")).alias("searchable"))


@query("""SELECT p_partkey, concat_ws(chr(10), 'name: ' || trim(p_name), 'size: ' || p_size, p_type) AS text FROM part""")
def chunk_texts(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", tables.chunk_text([("name", F.col("p_name")), ("none", F.lit(" ")), ("size", F.col("p_size"))], F.col("p_type")).alias("text"))


@query("""SELECT doc_id::VARCHAR AS id, nullif(trim(lang), '') AS lang, length(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), ' *\\r?\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS chars FROM documents""")
def normal_chunks(spark, sf_dir):
    return tables.normal_chunk(t(spark, sf_dir, "documents"), {"id": F.col("doc_id"), "lang": F.col("lang")}, F.col("text")).select("id", "lang", "chars")


@query("""WITH u AS (SELECT o_custkey AS id, 0 AS b, o_orderkey AS v FROM orders UNION ALL SELECT c_custkey, 1, 0 FROM customer), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b, v) AS n, count(*) OVER (PARTITION BY id) AS copies FROM u) SELECT id, v, copies FROM p WHERE n = 1""")
def chunk_union(spark, sf_dir):
    a = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("v"))
    b = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("v"))
    chunks, repeats = tables.union_first([a, b], "id")
    return chunks.join(repeats, "id", "left").select("id", "v", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


@query(r"""SELECT conv_id, turn, length(x) >= 10 AND NOT regexp_full_match(x, '[\d\s.,()\-/%]*') AS kept FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x FROM conversations)""")
def note_filter(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", tables.note_filter(F.col("text")).alias("kept"))


@query("""SELECT source, count(*) AS rows, count(*) FILTER (text IS NULL OR text = '') AS no_text, count(*) FILTER (NOT coalesce(n_chars > 100, false)) AS short FROM documents GROUP BY 1""")
def chunk_audit(spark, sf_dir):
    return tables.audit(t(spark, sf_dir, "documents"), ["source"], {"no_text": F.col("text") != "", "short": F.col("n_chars") > 100})


# ---- grounding and datasets


@query("""WITH c AS (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 7 < 3 THEN 0 ELSE 1000 END AS n, o_orderkey % 2 AS known, o_orderkey % 3 = 0 AS bare FROM orders),
u AS (SELECT *, CASE WHEN known = 1 OR (bare AND (n < 10 OR n BETWEEN 1900 AND 2100)) THEN [] ELSE [n::VARCHAR] END AS unsupported FROM c)
SELECT o_orderkey, unsupported, CASE WHEN len(unsupported) > 0 OR o_orderkey % 5 = 0 THEN 'RETRY' ELSE 'PASS' END AS verdict FROM u""")
def validation_verdict(spark, sf_dir):
    """Numbers with a percent sign always count; bare ones not if they are one digit or a year."""
    n = (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 < 3, 0).otherwise(1000)).cast("string")
    sign = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("%")
    answer, evidence = F.concat(F.lit("It is "), n, sign, F.lit(" now")), F.concat(F.lit("known: "), F.when(F.col("o_orderkey") % 2 == 0, F.lit("nothing")).otherwise(n))
    missing = grounding.unsupported_numbers(answer, evidence)
    return t(spark, sf_dir, "orders").select("o_orderkey", missing.alias("unsupported"), grounding.verdict(answer, evidence, missing, F.col("o_orderkey") % 5 != 0, F.lit(False)).alias("verdict"))


@query("""SELECT doc_id, length(regexp_replace(lower(coalesce(text, '')), '[\\s\\-_()/\\[\\]{}]+', '', 'g')) > 0 AND (contains(regexp_replace(lower(coalesce(text, '')), '[\\s\\-_()/\\[\\]{}]+', '', 'g'), 'theand') OR contains(regexp_replace(lower(coalesce(text, '')), '[\\s\\-_()/\\[\\]{}]+', '', 'g'), 'token')) AS covered FROM documents""")
def topics_covered(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", grounding.topics_covered(F.col("text"), F.array(F.lit("the and"), F.lit("Token"), F.lit(" - "))).alias("covered"))


@query("""SELECT o_orderkey, [1, 3] AS ids, CASE WHEN o_orderkey % 2 = 0 THEN 'total: ' || o_custkey ELSE 'row of ' || o_custkey END AS quote FROM orders""")
def source_repair(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    context = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x\ntotal: "), key)).otherwise(F.concat(F.lit("first\nrow of "), key))
    ids = grounding.valid_source_ids(F.array(F.lit("1"), F.lit("9"), F.lit("3"), F.lit("1"), F.lit("x")), F.lit(3))
    return t(spark, sf_dir, "orders").select("o_orderkey", ids.alias("ids"), grounding.repaired_quote(F.concat(F.lit("total: "), key), context).alias("quote"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS r FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r DESC, l_linenumber) AS n FROM a)
SELECT l_orderkey, r AS attempt_rank FROM p WHERE n = 1""")
def chosen_attempt(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") != "N").alias("answerable"), (F.col("l_linestatus") != "O").alias("valid"))
    return grounding.choose_attempt(rows, "l_orderkey").select("l_orderkey", "attempt_rank")


@query("""WITH q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'Q' || o_custkey END AS q, o_orderkey::VARCHAR AS a, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'e' END AS e, o_orderkey % 3 AS d FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(q) ORDER BY q, a) AS n FROM q)
SELECT o_orderkey, CASE WHEN q = '' THEN 'missing_field' WHEN n > 1 THEN 'duplicate_question' WHEN e = '' THEN 'no_evidence' WHEN d < 2 THEN 'too_few_documents' ELSE 'ok' END AS reason FROM n""")
def qa_reasons(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("Q"), F.col("o_custkey"))).alias("q"), key.cast("string").alias("a"), F.when(key % 4 == 0, "").otherwise("e").alias("e"), F.lit("compare").alias("task"), (key % 3).alias("d"))
    return grounding.qa_reason(rows, "q", "a", "e", "task", "d", ["compare"]).select("o_orderkey", "reason")


@query("""SELECT o_orderkey, '[' || o_orderkey || '] ' || o_orderstatus || chr(10) || o_orderpriority AS block FROM orders""")
def context_blocks(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", grounding.context_block(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("block"))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1995 THEN 'train' WHEN year(o_orderdate) = 1996 THEN 'validation' WHEN year(o_orderdate) >= 1998 THEN 'test' ELSE 'unused' END AS split FROM orders""")
def time_split(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", datasets.time_split(F.year("o_orderdate"), 1995, [1996], 1998).alias("split"))


@query("""WITH c AS (SELECT *, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, list_concat(CASE WHEN n > 1 AND o_orderpriority <> p THEN ['priority'] ELSE [] END, CASE WHEN n > 1 AND o_orderstatus <> s THEN ['status'] ELSE [] END) AS changed, ['priority'] AS numeric FROM c""")
def changed_fields(spark, sf_dir):
    fields = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    rows = t(spark, sf_dir, "orders").withColumn("fields", fields)
    out = datasets.changed_fields(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "fields")
    return out.select("o_orderkey", "changed", datasets.numeric_labels(F.col("fields")).alias("numeric"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders""")
def dense_ids(spark, sf_dir):
    return datasets.dense_ids(t(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


# ---- calculation plans: every order is one, its lines are its facts and its sources, of which the first five were retrieved

_PLANS = """p AS (SELECT o_orderkey AS plan_id, o_orderstatus <> 'P' AS answerable, ['sum', 'average', 'max', 'difference', 'ratio', 'median', 'guess'][1 + o_orderkey % 7] AS operation FROM orders),
u AS (SELECT l_orderkey AS plan_id, array_to_string(list(DISTINCT l_linenumber::VARCHAR ORDER BY l_linenumber::VARCHAR), ', ') AS unknown FROM lineitem WHERE l_linenumber > 5 GROUP BY 1),
c AS (SELECT plan_id, answerable, CASE WHEN answerable THEN operation END AS operation, CASE WHEN unknown IS NOT NULL THEN 'unknown sources: ' || unknown WHEN answerable AND operation = 'guess' THEN 'unsupported operation: guess' END AS fault FROM p LEFT JOIN u USING (plan_id))"""


def _plans(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("sum", "average", "max", "difference", "ratio", "median", "guess")])
    plans = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), (F.col("o_orderstatus") != "P").alias("answerable"), F.element_at(names, (1 + F.col("o_orderkey") % 7).cast("int")).alias("operation"))
    sources = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("source_id"))
    return plans, sources, sources.where("source_id <= 5")


@query(f"WITH {_PLANS} SELECT * FROM c")
def plan_checks(spark, sf_dir):
    return calculation.checked_plans(*_plans(spark, sf_dir))


@query(f"""WITH {_PLANS}, f AS (SELECT l_orderkey AS plan_id, sum(l_quantity) AS s, avg(l_quantity) AS a, max(l_quantity) AS m, median(l_quantity) AS d, max(l_quantity) FILTER (l_linenumber = 1) AS x, max(l_quantity) FILTER (l_linenumber = 2) AS y FROM lineitem GROUP BY 1),
r AS (SELECT c.*, CASE WHEN fault IS NULL AND answerable THEN CASE operation WHEN 'sum' THEN s WHEN 'average' THEN a WHEN 'max' THEN m WHEN 'difference' THEN x - y WHEN 'ratio' THEN x / nullif(y, 0) WHEN 'median' THEN d END END AS v FROM c LEFT JOIN f USING (plan_id))
SELECT plan_id, operation, round(v::DOUBLE, 6) AS result, CASE WHEN fault IS NOT NULL THEN 'fault' WHEN NOT answerable THEN 'insufficient' WHEN v IS NULL THEN 'undefined' ELSE 'ok' END AS status FROM r""")
def plan_results(spark, sf_dir):
    facts = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("position"), F.col("l_quantity").alias("value"))
    got = calculation.run_plans(calculation.checked_plans(*_plans(spark, sf_dir)), facts)
    return got.select("plan_id", "operation", F.round("result", 6).alias("result"), "status")


@query(f"WITH {_PLANS} SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS source_id FROM lineitem JOIN c ON plan_id = l_orderkey WHERE fault IS NULL AND l_linenumber <= 5")
def plan_sources(spark, sf_dir):
    plans, sources, chunks = _plans(spark, sf_dir)
    return calculation.selected_sources(calculation.checked_plans(plans, sources, chunks), sources, chunks.distinct())


@query("""SELECT l_suppkey, l_returnflag, year(l_shipdate) AS used_period, min(month(l_shipdate)) AS requested FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def fallback_notices(spark, sf_dir):
    fallbacks = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_orderkey").cast("string").alias("chunk_id"), F.year("l_shipdate").alias("used_period"), F.month("l_shipdate").alias("requested"))
    used = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit(" "), "o_orderkey").alias("chunk_id"))
    return calculation.fallback_notices(fallbacks, used, ["l_suppkey", "l_returnflag"], "requested", "used_period")


@query("""WITH n AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2), l AS (SELECT l_orderkey, string_agg('- ' || l_returnflag, chr(10) ORDER BY place, l_returnflag) AS lines FROM n GROUP BY 1)
SELECT o_orderkey, o_orderpriority || coalesce(chr(10) || chr(10) || lines, '') AS text FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def answers_with_sources(spark, sf_dir):
    sources = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linenumber")
    return calculation.answer_with_sources(t(spark, sf_dir, "orders"), sources, "o_orderkey", "o_orderpriority", "l_returnflag", "l_linenumber")
