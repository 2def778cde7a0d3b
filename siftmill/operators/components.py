"""Connected components of a similarity graph (survey J8, J9, J11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.plans.scratch import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Returns (node, component): component is the smallest node id reachable by `edges`.

    Alternates large-star and small-star contraction: every round is two aggregations over edges, the
    number of edges never grows beyond the input's, and O(log n) rounds suffice. Stars keep only
    (node -> minimum) pairs, so no adjacency list is ever collected. Only one number per round (how many
    edges changed) reaches the driver. Null endpoints and self-loops are ignored; repeated edges count
    once; an empty input gives an empty output; node ids may be of any orderable type.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    # each edge once, larger end first
    cur = scratch.save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), slim=True)

    minima: list[DataFrame] = []

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs (u, v) with u > v.  large: neighbours above a node go to the node's minimum;
        # small: a node and its neighbours below go to that minimum.
        both = pairs.union(pairs.select(F.col("v"), F.col("u"))) if large else pairs
        m = both.groupBy("u").agg(F.min("v").alias("m"))
        # written first, so that the join reads two tables and AQE can split a node with very many neighbours
        m = scratch.save(m.withColumn("m", F.least("u", "m")), slim=True)
        minima.append(m)
        j = both.join(m, "u")
        if large:
            out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    for _ in range(max_rounds):
        big = scratch.save(star(cur, True), slim=True)
        nxt = scratch.save(star(big, False), slim=True)
        scratch.drop(big, *minima)
        minima.clear()
        # done when the edges are stars: no node is both a child and a parent, and no child has two parents
        ends = nxt.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(nxt.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").limit(1).count()
        scratch.drop(cur)
        cur = nxt
        if not open_:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
