"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v). Minima combine on the map side; joining them back leaves a hub's edges to AQE's
    skew splitting, as each hub has a single row on the other side."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of each node that has an edge: node, component.

    Edges are columns u, v of an orderable type. Self-loops, repeats and nulls are ignored. No edges give no rows.
    Each round is written to the shared checkpoint folder; links and components stay distributed.
    """
    edges = cut(edges.select("u", "v").filter("u is not null and v is not null and u <> v").distinct())
    state = _state(edges)
    while state[0]:  # each round shortens the trees, so this ends after about the logarithm of the nodes
        edges = cut(_star(_star(edges, True), False))
        new = _state(edges)
        if new == state:
            break
        state = new
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
