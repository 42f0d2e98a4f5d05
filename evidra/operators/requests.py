"""Reading requests: periods, time and document slots, filters of documents by metadata and intent, keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from . import mentions

#: Names of the periodic reports.
REPORT_TYPES = {
    "사업보고서": "annual_report",
    "반기보고서": "semiannual_report",
    "분기보고서": "quarterly_report",
    "annual": "annual_report",
    "semiannual": "semiannual_report",
    "quarterly": "quarterly_report",
}
#: Names of a document group.
DOCUMENT_GROUPS = {
    "periodic": ("periodic", "정기공시", "사업보고서", "반기보고서", "분기보고서"),
    "major": ("major", "주요사항보고서", "주요사항", "주요경영사항"),
    "holding": ("holding", "지분공시", "주식등의대량보유상황보고서", "대량보유"),
    "exchange": ("exchange", "거래소공시", "한국거래소", "krx"),
}
#: Names of the halves of a year.
HALVES = {"H1": "H1", "H2": "H2", "상반기": "H1", "하반기": "H2", "1": "H1", "2": "H2"}


def report_type(kind: Column, subtype: Column) -> Column:
    """The canonical report type by the kind's name, then by the subtype's; else the kind as it is."""
    own = T.clean(kind)
    return T.mapped(own, REPORT_TYPES, T.mapped(T.clean(subtype), REPORT_TYPES, own))


def report_label(kind: Column, labels: dict[str, str]) -> Column:
    return T.mapped(kind, labels, kind)


def period_bucket(basis: Column, base_year: Column, received: Column, event: Column) -> Column:
    """The year (as text) that a document counts for under its date basis; unknown without one. Dates are keys."""
    key = F.when(basis == "event_date", event).otherwise(received)
    year = F.when(basis == "base_year", F.nullif(base_year, F.lit(0))).otherwise(F.floor(key / 10000))
    return F.coalesce(year.cast("long").cast("string"), F.lit("unknown"))


def matches_intent(report: Column, month: Column, intent: Column) -> Column:
    """Documents that are no periodic report always match; periodic ones by the intent's report and month, if it has any."""
    fits = (report == intent["report"]) & (intent["month"].isNull() | F.coalesce(month == intent["month"], F.lit(False)))
    return intent.isNull() | ~report.isin(*D.PERIODIC) | fits


def fallback_documents(documents: DataFrame, missing: DataFrame, request: str, bucket: str, report: str) -> DataFrame:
    """Periodic reports of the (request, bucket) cells that are missing."""
    cells = missing.select(request, F.col(bucket).cast("string").alias(bucket)).distinct()
    return documents.where(F.col(report).isin(*D.PERIODIC)).join(cells, [request, bucket], "left_semi")


def metadata_filter(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal every value given; None leaves a column free."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def value_filter(c: Column, values: Sequence[object]) -> Column:
    """Equality for one value, membership for several; nothing matches none."""
    return F.lit(False) if not values else c == F.lit(values[0]) if len(values) == 1 else c.isin(*values)


def time_request(kind: Column, year: Column, quarter: Column, half: Column) -> Column:
    """(supported, base_year, base_month, reason) of a point in time; a quarter goes before a half, ranges are told apart."""
    kind = F.trim(F.coalesce(kind, F.lit("")))
    month = F.coalesce(F.when(quarter.between(1, 4), quarter * 3), F.when(half.between(1, 2), half * 6)).cast("int")
    row = lambda ok, y, m, why: F.struct(F.lit(ok).alias("supported"), y.cast("int").alias("base_year"), m.cast("int").alias("base_month"), why.alias("reason"))
    none, no_reason = F.lit(None), F.lit(None).cast("string")
    return (
        F.when(kind == "", row(True, none, none, no_reason))
        .when(kind == "point", row(True, year, month, no_reason))
        .when(kind == "range", row(False, none, none, F.lit("a range needs several periods")))
        .otherwise(row(False, none, none, F.concat(F.lit("unsupported time type: "), kind)))
    )


def document_group(kinds: Column) -> Column:
    """The one group that all named kinds map to; null if several, or none is known."""
    names = {name: group for group, listed in DOCUMENT_GROUPS.items() for name in listed}
    found = F.array_distinct(F.array_compact(F.transform(kinds, lambda k: T.mapped(k, names, F.lit(None).cast("string")))))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def time_slots(body: Column) -> Column:
    """(time_type, start_year, start_quarter, start_half, end_...) of a struct (type, start, end) of texts; bad parts are null."""
    number = lambda c: F.trim(c).try_cast("int")
    quarter = lambda c: F.when(number(c).between(1, 4), number(c))
    half = lambda c: T.mapped(F.upper(F.trim(c)), HALVES, F.lit(None).cast("string"))
    kind = F.lower(F.trim(F.coalesce(body["type"], F.lit("unknown"))))
    kind = F.when(kind.isin("point", "range") & number(body["start"]["year"]).isNotNull(), kind).otherwise("unknown")
    parts = [f(body[end][name]).alias(f"{end}_{name}") for end in ("start", "end") for name, f in (("year", number), ("quarter", quarter), ("half", half))]
    return F.struct(kind.alias("time_type"), *parts)


def meaningful_topics(topics: Column, excluded: Column) -> Column:
    """Topics that are no name of the scope and not only a time."""
    names = F.transform(excluded, lambda x: T.lookup_key(x))
    bare = lambda t: F.trim(F.regexp_replace(t, r"20\d{2}\s*년?|[1-4]\s*분기|상반기|하반기", ""))
    timed = lambda t: t.rlike(r"20\d{2}") & (bare(t) == "")
    return F.filter(topics, lambda t: (T.lookup_key(t) != "") & ~F.array_contains(names, T.lookup_key(t)) & ~timed(t))


def missing_slots(scope_type: Column, scope: Column, time: Column, metrics: Column, topics: Column) -> Column:
    """Which of scope, time and topic a request lacks, in that order."""
    has_scope = (F.size(scope) > 0) | F.coalesce(scope_type == "all", F.lit(False))
    point = (time["time_type"] == "point") & time["start_year"].isNotNull()
    span = (time["time_type"] == "range") & time["start_year"].isNotNull() & time["end_year"].isNotNull()
    has_topic = (F.size(metrics) > 0) | (F.size(meaningful_topics(topics, scope)) > 0)
    lacks = lambda there, name: F.when(~F.coalesce(there, F.lit(False)), F.lit(name))
    return F.array_compact(F.array(lacks(has_scope, "scope"), lacks(point | span, "time"), lacks(has_topic, "topic")))


def grounded_keywords(requests: DataFrame, pool: DataFrame, blocked: DataFrame, generic: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys..., keywords): a request's keywords that the pool knows, spelled as the pool's first spelling, each once in order.

    requests: keys, position, keyword. pool: position, keyword. blocked: keyword (companies, document kinds). Keys
    shorter than two signs, blocked and generic ones never count.
    """
    keyed = lambda df: df.withColumn("_key", T.match_key(F.col("keyword"))).where(F.length("_key") >= 2)
    allowed = keyed(pool).join(keyed(blocked).select("_key").distinct(), "_key", "left_anti").where(~F.col("_key").isin(*generic) if generic else F.lit(True))
    spelled = allowed.groupBy("_key").agg(F.min_by(T.clean(F.col("keyword")), F.struct("position", "keyword")).alias("_shown"))
    first = keyed(requests).groupBy(*keys, "_key").agg(F.min("position").alias("position")).join(spelled, "_key")
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "_shown"))), lambda x: x["_shown"]).alias("keywords"))


def first_aliases(companies: DataFrame, alias: str, code: str, order: str) -> DataFrame:
    """(alias, code): of a repeated alias the first company wins; aliases are compared by their key."""
    return companies.withColumn("_alias", T.alias_key(F.col(alias))).where("_alias <> ''").groupBy(F.col("_alias").alias("alias")).agg(F.min_by(code, order).alias("code"))


def ambiguous_families(companies: DataFrame, name: str, code: str, length: int = 2) -> DataFrame:
    """(prefix, members): beginnings of names that several companies share."""
    heads = companies.select(F.substring(T.alias_key(F.col(name)), 1, length).alias("prefix"), F.col(code).alias("_code")).where(F.length("prefix") == length)
    return heads.groupBy("prefix").agg(F.count_distinct("_code").alias("members")).where("members > 1")


def longest_mention(questions: DataFrame, names: DataFrame, question: str, text: str, name: str, code: str) -> DataFrame:
    """(question, code, name): the longest name whose key a question's key contains; ties go to the smaller name, then code."""
    keyed = names.select(T.match_key(F.col(name)).alias("_key"), F.col(name).alias("_name"), F.col(code).alias("_code"))
    places = mentions.occurrences(questions, text, names, name, [question]).select(question, F.col("name").alias("_key")).distinct()
    longest = F.min(F.struct(-F.length("_key"), "_name", "_code")).alias("_best")
    return places.join(keyed, "_key").groupBy(question).agg(longest).select(question, F.col("_best._code").alias("code"), F.col("_best._name").alias("name"))


def is_index_record(field: Column) -> Column:
    """Records of list pages, which are no documents."""
    return F.startswith(F.lower(F.coalesce(field, F.lit(""))), F.lit("list_"))


def outside_window(df: DataFrame, key: Column, first: int, last: int) -> DataFrame:
    """Rows whose date key lies outside the window, or is missing."""
    return df.where(~F.coalesce(key.between(first, last), F.lit(False)))


def plan_error(request_id: Column, position: Column, kinds: Column, lower: Column, upper: Column, known: Sequence[str], most: int = 3) -> Column:
    """The first fault of a planned request: its number, its count of report types, an unknown type, its period; null if none."""
    wanted = F.concat(F.lit("request_"), F.lpad(position.cast("string"), 3, "0"))
    return (
        F.when(~request_id.eqNullSafe(wanted), "request_id")
        .when(~F.coalesce(F.size(kinds).between(1, most), F.lit(False)), "report_types")
        .when(F.size(F.array_except(kinds, F.array(*[F.lit(k) for k in known]))) > 0, "unknown_report_type")
        .when(lower.isNull() | upper.isNull() | (lower > upper), "period")
    )
