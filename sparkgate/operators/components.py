"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgate.session import drop_materialized, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (v, m) with v > m.

    The minimum per node is a partial aggregate, written, and comes back by an equi-join: between two shuffled tables the skew
    join can split a node with very many neighbours, which it can't where one side is still an aggregate.
    """
    if large:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("n")).union(edges.select(F.col("m").alias("u"), F.col("v").alias("n")))
    else:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("n"))
    least = materialize(both.groupBy("u").agg(F.least(F.min("n"), F.first("u")).alias("least")), "least")
    joined = both.join(least, "u")
    if large:
        out = joined.where("n > u").select(F.col("n").alias("v"), F.col("least").alias("m"))
    else:
        out = joined.where("n > least").select(F.col("n").alias("v"), F.col("least").alias("m")).union(least.select(F.col("u").alias("v"), F.col("least").alias("m")))
    return out.where("v > m").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id over undirected links.

    Ids are long. Links with a null end or with equal ends are no links; repeated links and either direction are fine. Ids without
    links are not listed; an empty link table gives an empty result. Links never leave the executors: every round is
    written to the shared folder and the driver sees only whether a round changed anything.
    """
    edges = materialize(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("v"), F.least(a, b).cast("long").alias("m")).distinct(), "links")
    while True:
        step = materialize(_star(_star(edges, True), False), "links")
        drop_materialized(edges)
        edges = step
        # Finished when every node points to one root and no root points on.
        twice = edges.groupBy("v").agg(F.count("*").alias("n"), F.min("m").alias("m"))
        roots = edges.select(F.col("m").alias("v"))
        if twice.where("n > 1").isEmpty() and roots.join(edges, "v", "left_semi").isEmpty():
            break
    return edges.select(F.col("v").alias("id"), F.col("m").alias("component")).union(edges.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())
