"""Connected components of a distributed edge list, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import Scratch


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component is the smallest node reachable.

    Alternating large-star and small-star steps: each round links the larger neighbours of a node, then the
    smaller ones, to its smallest neighbour, so that the number of edges never grows and stars remain after
    O(log^2) rounds. Every step is a min per node (combined before the shuffle and written down, so that it is a
    plain side of a join) and a join that Spark can split when a hub holds many edges. Self-loops and repeated edges are allowed; an empty list gives an empty
    result. What a round wrote is deleted once the next one is written.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    n, before = e.count(), None
    for _ in range(max_rounds):
        if n == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.stage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = scratch.stage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = scratch.stage(small)
        scratch.clear(but=1)
        n, total = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
