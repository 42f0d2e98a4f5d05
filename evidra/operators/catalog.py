"""Scopes, aliases, document filters by period, correction closure and audits of the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from . import intervals, mentions


def aliases(companies: DataFrame, code: str, columns: Sequence[str]) -> DataFrame:
    """(alias, code): the match key of each non-empty name column."""
    names = F.explode(F.array_distinct(F.array(*[T.match_key(F.col(c).cast("string")) for c in columns])))
    return companies.select(names.alias("alias"), F.col(code).alias("code")).where("alias <> ''").distinct()


def resolve_direct(requests: DataFrame, alias_table: DataFrame, value: str = "value") -> DataFrame:
    """requests with (code, status): resolved, ambiguous (several codes; code is null) or unknown."""
    keyed = requests.withColumn("_key", T.match_key(F.col(value)))
    codes = alias_table.groupBy("alias").agg(F.count_distinct("code").alias("_n"), F.min("code").alias("_code"))
    joined = keyed.join(codes, F.col("_key") == F.col("alias"), "left")
    status = F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    return joined.select(*requests.columns, F.when(F.col("_n") == 1, F.col("_code")).alias("code"), status.alias("status"))


def resolve_contains(requests: DataFrame, alias_table: DataFrame, value: str = "value", least: int = 2) -> DataFrame:
    """Exact keys first; the rest by containment of keys, as (requests..., code, matched): exact, part or null.

    The distinct keys that no alias equals are sought in all aliases at once, so tables of any size can be resolved.
    """
    keyed = requests.withColumn("_key", T.lookup_key(F.col(value)))
    exact = keyed.join(alias_table, F.col("_key") == F.col("alias")).select(*requests.columns, "code", F.lit("exact").alias("matched"))
    rest = keyed.join(alias_table, F.col("_key") == F.col("alias"), "left_anti")
    parts = mentions.contained(rest, F.col("_key"), alias_table, "alias", least).select(F.col("needle").alias("_needle"), F.col("value").alias("_alias"))
    coded = parts.join(alias_table, F.col("_alias") == F.col("alias")).select("_needle", "code")
    held = rest.join(coded, F.col("_key") == F.col("_needle"), "left")
    return exact.unionByName(held.select(*requests.columns, "code", F.when(F.col("code").isNotNull(), "part").alias("matched")))


def in_scope(companies: DataFrame, scope_type: str, values: Sequence[str], code: str, column: str | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Codes of a scope: all, or those whose column has one of the values; unknown values raise."""
    if scope_type == "all":
        found = companies.select(code)
    else:
        if column is None:
            raise ValueError(f"scope {scope_type} needs a column")
        known = {r[0] for r in companies.where(F.col(column).isin(*values)).select(column).distinct().collect()}
        if missing := set(values) - known:
            raise ValueError(f"unknown {scope_type}: {', '.join(sorted(missing))}")
        found = companies.where(F.col(column).isin(*values)).select(code)
    found = found.distinct()
    return found if documents is None else found.join(documents, code, "left_semi")


def period_key(year: Column, month: Column) -> Column:
    """Sortable key of a fiscal period; a missing month counts as December."""
    return year * 10000 + F.coalesce(month, F.lit(12)) * 100 + 1


def matches_period(key: Column, lower: Column, upper: Column, month: Column | None = None, fine: Column | None = None) -> Column:
    """Within the closed interval; documents without a month never match a quarter or half."""
    inside = key.between(lower, upper)
    return inside if month is None or fine is None else inside & ~(fine & month.isNull())


def documents_in_period(documents: DataFrame, requests: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    """(request, document) rows: equal on keys, the document's key within [lower, upper] of the request."""
    return intervals.points_in(documents, key, requests, "lower", "upper", keys)


def with_periodic(requested: DataFrame, periodic: DataFrame, request: str, document: str) -> DataFrame:
    """Requested documents and the periodic reports, one row for each request and document; requested ones win."""
    both = requested.withColumn("_from", F.lit(0)).unionByName(periodic.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    first = both.groupBy(request, document).agg(F.min(F.struct("_from", *[c for c in requested.columns if c not in (request, document)])).alias("_row"))
    return first.select(request, document, "_row.*").drop("_from")


def closure(edges: DataFrame, checkpoints: str | None = None) -> DataFrame:
    """(node, component) of the undirected graph of edges (src, dst): the smallest node reachable.

    Min-label rounds with root hooking and pointer jumping until nothing changes, each cut off by checkpoint() in the shared folder (``spark.checkpoint.dir``,
    or the given one where that is unset).
    """
    spark = edges.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or checkpoints
    if shared:
        spark.sparkContext.setCheckpointDir(shared)
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    labels = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy("src").agg(F.min("c").alias("c"))
        met = labels.join(near, labels["node"] == near["src"]).select("node", "component", "c")
        hooks = met.groupBy(F.col("component").alias("root")).agg(F.min("c").alias("hooked"))
        moved = met.join(hooks, met["node"] == hooks["root"], "left").select("node", F.col("component").alias("before"), F.least("component", "c", "hooked").alias("component"))
        head = moved.select(F.col("node").alias("head"), F.col("component").alias("jump"))
        following = moved.join(head, moved["component"] == head["head"], "left").select("node", "before", F.least("component", F.coalesce("jump", "component")).alias("component")).checkpoint()
        done = following.where("component <> before").isEmpty()
        labels = following.select("node", "component")
        if done:
            return labels


def expand_seeds(seeds: DataFrame, edges: DataFrame, document: str, checkpoints: str | None = None) -> DataFrame:
    """Seeds (document, other columns) and every document connected to them."""
    labels = closure(edges, checkpoints)
    marked = seeds.join(labels, seeds[document] == labels["node"]).select(*[c for c in seeds.columns if c != document], "component").distinct()
    reached = marked.join(labels, "component").select(*[c for c in seeds.columns if c != document], F.col("node").alias(document))
    return seeds.select(*reached.columns).union(reached).distinct()


def one_sided(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys on one side only."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("right")))


def coverage_pivot(df: DataFrame, key: str, year: Column, years: Sequence[int]) -> DataFrame:
    """Counts of each year as columns y<year>, and whether all are positive."""
    counts = df.groupBy(key).agg(*[F.count(F.when(year == y, 1)).alias(f"y{y}") for y in years])
    full = F.lit(True)
    for y in years:
        full = full & (F.col(f"y{y}") > 0)
    return counts.withColumn("complete", full)


def chain_counts(df: DataFrame, chain: str, least: int = 2) -> DataFrame:
    return df.groupBy(chain).agg(F.count("*").alias("members")).where(F.col("members") >= least)


def enrich(records: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Left outer join; a record's own values win, the manifest fills what is null. Of a repeated key the last row wins.

    Rows of the manifest have no order of their own in a table, so the last is the largest by its columns in turn.
    """
    rest = [c for c in manifest.columns if c != key]
    if rest:
        manifest = manifest.groupBy(key).agg(F.max(F.struct(*rest)).alias("_last")).select(key, "_last.*")
    added = manifest.select(*[F.col(c).alias(c if c == key else f"_m_{c}") for c in manifest.columns])
    joined = records.join(added, key, "left")
    columns = [F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c != key and c in manifest.columns else F.col(c) for c in records.columns]
    return joined.select(*columns, *[F.col(f"_m_{c}").alias(c) for c in manifest.columns if c not in records.columns])


DATE_KEY = D.key_of
