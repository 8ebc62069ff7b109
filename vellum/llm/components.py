"""Connected components of a graph that no one machine holds: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "graph") -> DataFrame:
    """edges (a long, b long) -> (node, component) for each node that has an edge to another; component is the least node.

    Each round hangs every neighbour of a node on the least one it knows, first the larger neighbours,
    then the smaller, so paths shorten by half and the edges end as stars. A node's neighbours are
    never gathered in one place: their minimum is an aggregate with partial sums and comes back by a
    join, which splits hot nodes. A round's edges are written to the shared folder.
    """
    live = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state = None
    for turn in range(1, 64):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large, f"{name}-large-{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        live = scratch.write(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{name}-{turn}")
        now = live.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        state = (now["n"], now["h"])
    else:
        raise RuntimeError("components did not settle in 63 rounds")
    return live.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(live.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
