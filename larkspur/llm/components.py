"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, scratch


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (vertex, component), component being the smallest vertex reachable.

    Each round gives every vertex its smallest neighbour as parent (a plain aggregate, so a vertex with very
    many links is combined before the shuffle), follows parents to their roots by doubling, and contracts the
    links onto the roots; at least half of the linked vertices go in each round. Loops and repeated links are
    harmless. Vertices without links aren't listed; an empty table gives an empty result.
    """
    with scratch(links.sparkSession):
        return _components(links)


def _components(links: DataFrame) -> DataFrame:
    edges = checkpoint(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("m")).select("vertex", F.least("vertex", "m").alias("parent"))
        parents = checkpoint(parents)
        while True:
            up = parents.select(F.col("vertex").alias("parent"), F.col("parent").alias("next"))
            jumped = checkpoint(parents.join(up, "parent").select("vertex", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
            parents = jumped.select("vertex", "parent")
            if jumped.where("moved").isEmpty():
                break
        of_a = parents.select(F.col("vertex").alias("a"), F.col("parent").alias("pa"))
        of_b = parents.select(F.col("vertex").alias("b"), F.col("parent").alias("pb"))
        edges = edges.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        edges = checkpoint(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if found is None:
            found = parents.select("vertex", F.col("parent").alias("component"))
        else:
            up = parents.select(F.col("vertex").alias("component"), "parent")
            found = found.join(up, "component", "left").select("vertex", F.coalesce("parent", "component").alias("component"))
    if found is None:
        found = edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return checkpoint(found, out=True)
