"""Connected components of a link table by contraction: the links shrink every round, nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Rows of a table of two ids that is broadcast; with more, the lookup is a shuffled join that AQE may split.
SENT = 500_000


def _looked_up(rows: DataFrame, column: str, parents: DataFrame, few: bool) -> DataFrame:
    """rows with the ids of a column replaced by their parents, where they have one."""
    to = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    joined = rows.join(F.broadcast(to) if few else to, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_parent", column)).drop("_node", "_parent")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for every node that has a link to another.

    Each round, every node takes its least neighbour for its parent if that is smaller than itself; parents' parents
    are followed, links are renamed by parents and those within one name go. What is left is contracted again until no
    link is left, so chains settle in about logarithmic rounds; then the rounds' parents are looked up backwards. Ids
    that many rows share (hubs, large components) are looked up by broadcast where the table of parents is small. Null
    ends, repeated links and self-links change nothing.
    """
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(ordered(links.select("a", "b")), "graph-links")
    rounds: list[tuple[DataFrame, bool]] = []
    while not edges.isEmpty():
        parents = stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "graph-parents")
        few = parents.count() <= SENT
        for _ in range(2):  # each doubles the way that is followed
            parents = _looked_up(parents, "parent", parents, few)
        parents = stored(parents, "graph-parents")
        rounds.append((parents, few))
        renamed = stored(ordered(_looked_up(_looked_up(edges, "a", parents, few), "b", parents, few)), "graph-links")
        forget(edges)
        edges = renamed
    if not rounds:
        return links.select(F.col("a").cast("long").alias("node"), F.col("a").cast("long").alias("component")).limit(0)
    known, few = rounds[-1]
    for parents, _ in reversed(rounds[:-1]):
        both = _looked_up(parents, "parent", known, few).unionByName(known)  # a node that others were renamed to may be in both, with one root
        known = stored(both.groupBy("node").agg(F.min("parent").alias("parent")), "graph-labels")
        few = few and known.count() <= SENT
    labels = known.select("node", F.col("parent").alias("component"))
    roots = labels.select("component").distinct()
    return stored(labels.unionByName(roots.select(F.col("component").alias("node"), "component")), "graph-labels")
