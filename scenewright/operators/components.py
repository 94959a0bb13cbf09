"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step points every node's neighbours at the smallest node it knows; the table converges to one star for each
component.  A step is a combinable minimum by node and an equi-join that adaptive execution can split at a hot node; its
result is written to the shared folder, so lineage doesn't grow.  The links stay distributed throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.functions.store import drop, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with v < u.  Large: all neighbours; small: the smaller ones only."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc")
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = saved(edges.groupBy("u").agg(F.min("v").alias("m")), "cc")
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    done = saved(out.filter("u <> v").distinct(), "cc")
    drop(least)
    return done


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones: then each star is a component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 OR below > 0 AND above > 0").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another; component is the smallest node reachable.

    Nulls, self-links and repeated links don't matter; an empty table gives an empty one."""
    edges = saved(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    while not _stars_only(edges):
        big = _star(edges, True)
        small = _star(big, False)
        drop(edges, big)
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
