"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.lineage import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of edges(u, v); the component is its smallest id.

    Alternates two steps until the edges are stars around the smallest ids: every node links its larger neighbours to
    its smallest one, then its smaller neighbours (and itself) to the smallest.  The number of rounds grows with the
    logarithm of a component's size.  Minima are aggregated before the shuffle; the join that brings them back is one
    that Spark can split at a hub.  Each round is written to the shared checkpoint folder.
    """
    u, v = F.col("u"), F.col("v")
    now = durable(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct())
    while not _stars(now):
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(_rekeyed(least), "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_rekeyed(least), "u").select(F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v")).where("u > v")
        now = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = now.select(v.alias("id")).distinct()
    return now.select(u.alias("id"), v.alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def _rekeyed(least: DataFrame) -> DataFrame:
    """The same rows with a key whose partitioning Spark does not know.

    The join then deals out this side anew, and a join of two plain exchanges is one that Spark can split at a hub.
    """
    return least.select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("u"), "m")


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (larger, smaller) are stars: no node has two smaller neighbours, or one of either kind."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.bool_or((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]
