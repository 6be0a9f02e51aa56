"""Connected components by alternating large-star and small-star steps.

Each step groups the edges by a vertex with a map-side minimum; edges stay distributed, those
of a vertex with a large share of them too, and the lineage is cut in every round. The rounds needed grow with the logarithm of the size of
the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.operators.salted import heavy_hashes, salted_join
from siltwork.session import cut, release

MOST_ROUNDS = 50
HUB_SHARE = 0.01
FEW_EDGES = 1_000_000  # up to which no vertex has so many that one task couldn't take them


def _star(edges: DataFrame, large: bool, hubs: bool) -> DataFrame:
    """One step: every neighbour (larger ones, or smaller ones and the vertex) is linked to the smallest in reach."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hubs = heavy_hashes(both, [F.col("u")], HUB_SHARE) if hubs else []
    near = salted_join(both, low, "u", F.col("v"), hubs)
    if large:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each u has one v, and no v is a u of another edge."""
    ends = edges.select(F.col("u").alias("x"), "v").unionByName(edges.select(F.col("v").alias("x"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    seen = ends.groupBy("x").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.col("v").isNull()).alias("is_v"))
    return seen.where("lo <> hi OR (is_v AND lo IS NOT NULL)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex on an edge (u, v); component is the smallest vertex. Null ends are no vertices."""
    edges = cut(edges.where("u <> v").select("u", "v").distinct())
    for _ in range(MOST_ROUNDS):
        hubs = edges.count() > FEW_EDGES
        before, edges = edges, cut(_star(_star(edges, True, hubs), False, hubs))
        release(before)
        if _settled(edges):
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
