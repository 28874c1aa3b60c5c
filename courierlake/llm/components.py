"""Connected components of a graph given by its edges, by alternating stars.

Defined cases: edges with a null end and edges from a node to itself link nothing and are left out, as are nodes
that have no others; repeated and reversed edges count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (the smallest node of its component) for every node that has an edge to another node.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node around; both
    steps are aggregations with map-side combination and equi-joins. Rounds are written to the shared folder; they
    end when nothing changes, after about the logarithm of the longest path.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    links = ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = materialize(links, "links")
    now = before = None
    while now is None or now != before:
        before = now
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        fresh = materialize(small, "links")
        discard(links)
        links = fresh
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    comps = links.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return comps.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
