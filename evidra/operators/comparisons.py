"""Groups of documents to compare: every n in a row of a company, a chain, a metric or an industry's quarter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import named
from .numbering import numbered

#: The kinds of groups, sizes that are made, and days that documents of different companies may lie apart.
KINDS = ("same_company_same_report_type", "correction_chain", "same_company_same_metric", "cross_company_same_report_type")
SIZES = (2, 3, 4)
NEAR_DAYS = 90
#: Rows of one block; a block is the largest group that a task sorts, however many rows a key has.
BLOCK = 1 << 18


def in_a_row(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, block: int = BLOCK) -> DataFrame:
    """(row, rows): each row with itself and the n - 1 that follow it in order among those equal on keys, as structs.

    All rows are sorted by keys and order over the whole cluster and cut into blocks of equal size that overlap by n - 1
    rows, so a key that holds a third of all rows is spread like any other. Rows without enough followers are left out;
    null keys are equal to each other; ties follow in any order, so ``order`` should end with an id.
    """
    packed = rows.select(*[named(c).alias(f"key_{k}") for k, c in enumerate(keys)], *[o.alias(f"order_{k}") for k, o in enumerate(order)], F.struct(*[named(c).alias(c) for c in rows.columns]).alias("row"))
    own = [f"key_{k}" for k in range(len(keys))]
    sorted_ = numbered(packed, [*own, *[f"order_{k}" for k in range(len(order))]], "at", 0).select("at", F.struct(*own).alias("key") if own else F.lit(0).alias("key"), "row")
    block_of = F.floor(F.col("at") / block)
    blocks = F.array_compact(F.array(block_of, F.when((F.col("at") % block < n - 1) & (F.col("at") >= block), block_of - 1)))
    spread = sorted_.withColumn("block", F.explode(blocks))
    follow = Window.partitionBy("block").orderBy("at").rowsBetween(0, n - 1)
    met = spread.select("block", "at", F.collect_list("key").over(follow).alias("keys"), F.collect_list("row").over(follow).alias("rows"))
    whole = (F.size("rows") == n) & (F.floor(F.col("at") / block) == F.col("block")) & F.element_at("keys", 1).eqNullSafe(F.element_at("keys", -1))
    return met.where(whole).select(F.element_at("rows", 1).alias("row"), "rows")


def group_id(kind: str, ids: Column) -> Column:
    digest = F.sha1(F.concat(F.lit(f"{kind}|"), F.array_join(F.transform(ids, lambda i: i.cast("string")), "|")).cast("binary"))
    return F.concat(F.lit(f"{kind}_"), F.substring(digest, 1, 12))


def groups_of(records: DataFrame, kind: str, n: int, company: str = "company", report: str = "report", date: str = "date", record: str = "id", chain: str = "chain", metrics: str = "metrics", days: int = NEAR_DAYS, block: int = BLOCK) -> DataFrame:
    """(kind, group_id, ids, about, gap): every n records in a row (by date, null first, then id) that make a group of the kind.

    Of one company and report type there must be two dates at least; chains are those that have an id; of one company
    and metric (an array column) no more is asked; of different companies with one report type no company may come twice,
    every date must be known and the first and last lie within ``days``. about holds the two values that the group
    shares, the smaller pair where several share its ids; gap is in days. A set of ids makes one group of a kind; groups
    in which an id repeats are none.
    """
    if kind not in KINDS or n not in SIZES:
        raise ValueError(f"no such groups: {kind} of {n}")
    rows = records.select(named(company).alias("company"), named(report).alias("report"), named(date).cast("date").alias("date"), named(record).alias("id"), *[named(c).alias(a) for c, a in ((chain, "chain"), (metrics, "metrics")) if c in records.columns])
    keys = {"same_company_same_report_type": ["company", "report"], "correction_chain": ["chain"], "same_company_same_metric": ["company", "metric"], "cross_company_same_report_type": ["report"]}[kind]
    if kind == "correction_chain":
        rows = rows.where("chain IS NOT NULL AND CAST(chain AS STRING) <> ''")
    if kind == "same_company_same_metric":
        rows = rows.withColumn("metric", F.explode(F.array_distinct("metrics")))
    rows = rows.drop("metrics")
    found = in_a_row(rows, keys, [F.col("date"), F.col("id")], n, block)
    each = lambda c: F.transform("rows", lambda r: r[c])
    ids, dates, companies = each("id"), each("date"), each("company")
    gap = F.date_diff(F.array_max(dates), F.array_min(dates))
    good = F.size(F.array_distinct(ids)) == n
    if kind == "same_company_same_report_type":
        good &= F.size(F.array_distinct(F.array_compact(dates))) >= 2
    if kind == "cross_company_same_report_type":
        good &= (F.size(F.array_distinct(companies)) == n) & (F.size(F.array_compact(dates)) == n) & (gap <= days)
    first = {"same_company_same_report_type": ("company", "report"), "correction_chain": ("chain", "company"), "same_company_same_metric": ("company", "metric"), "cross_company_same_report_type": ("report", "report")}[kind]
    about = F.array(*[F.col(f"row.{c}").cast("string") for c in first])
    made = found.where(good).select(ids.alias("ids"), about.alias("about"), gap.alias("gap"))
    once = made.groupBy(F.array_sort("ids").alias("set")).agg(F.min(F.struct("about", "ids", "gap")).alias("g"))
    return once.select(F.lit(kind).alias("kind"), group_id(kind, F.col("g.ids")).alias("group_id"), "g.ids", "g.about", "g.gap")
