"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import settled


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node of the node's component.

    edges: two columns of one orderable type. Null ends and loops are left out, repeated edges count once, an empty
    table gives an empty result. Each step shuffles by node: the least neighbour is pre-aggregated before the shuffle,
    and a hub's rows meet its least neighbour in a join that AQE may split. Every round's edges are written to the
    shared folder, in place of the round's before, so that no round depends on an earlier one. RuntimeError if the rounds don't suffice; they
    grow as the square of the logarithm of the number of nodes at most.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = settled(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settled(small.union(least).distinct(), "edges", instead=(e,))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        seen = now
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
