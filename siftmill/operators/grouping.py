"""Groups of similar items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.operators.components import connected_components
from siftmill.plans.scratch import Scratch


def similarity_groups(items: DataFrame, pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """(item_id, group_id): components of the pairs' graph; items without a partner are groups of their own."""
    comp = connected_components(pairs)
    j = items.select(F.col(id_col).alias("item_id")).join(comp.withColumnRenamed("node", "item_id"), "item_id", "left")
    return j.select("item_id", F.coalesce("component", "item_id").alias("group_id"))


def groups_only(groups: DataFrame) -> DataFrame:
    """The groups of at least two items."""
    w = Window.partitionBy("group_id")
    return groups.withColumn("_n", F.count("*").over(w)).where("_n > 1").drop("_n")


def _taken_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The later ends that are taken, of pairs (late, early) sorted by their later end: those with an earlier partner that is not. Of the last
    one pairs may be missing; if it is not seen to be taken, it stays open with those."""
    taken: set = set()
    current, hit = None, False
    for pdf in batches:
        out = []
        for late, early in zip(pdf["late"], pdf["early"], strict=True):
            if late != current:
                if hit:
                    taken.add(current)
                    out.append(current)
                current, hit = late, False
            hit = hit or early not in taken
        yield pd.DataFrame({"late": out}, dtype=pdf["late"].dtype)
    if hit:
        yield pd.DataFrame({"late": [current]})


def star_groups(items: DataFrame, pairs: DataFrame, id_col: str = "id", order_col: str | None = None, block_edges: int = 1_000_000) -> DataFrame:
    """(item_id, group_id): greedy stars. In the order of (`order_col`, id), an item in no group founds one and takes its
    partners that are in none; partners of partners do not join. Items of equal fingerprints are partners like any others.

    The founders are the greedy independent set of that order, found in rounds on written tables: an item that precedes all its undecided partners
    founds a group, and its partners are taken. Orders that leave little to a round, as along a chain, are gone through one item after the other, the
    first `block_edges` undecided pairs at a time, which bounds what one task reads. A taken item then goes to its first founder.

    Defined cases: null orders come first; repeated items, the first order counting, and repeated pairs count once; pairs with an end that is
    no item are ignored, as are pairs of an item with itself; without pairs every item is a group.
    """
    scratch = Scratch(items.sparkSession, "stars")
    at = F.col(order_col) if order_col and order_col != id_col else F.lit(0)
    item = items.select(F.col(id_col).alias("item_id"), at.alias("at")).where("item_id is not null").groupBy("item_id").agg(F.min(F.struct("at")).alias("o"))
    item = scratch.save(item.select("item_id", F.col("o.at").alias("at")))
    # each pair once, from the later item to the earlier
    x = pairs.select("a", "b").where("a <> b").join(item.toDF("a", "at_a"), "a").join(item.toDF("b", "at_b"), "b")
    swap = F.struct("at_a", "a") < F.struct("at_b", "b")
    first = lambda p, q, name: F.when(swap, F.col(p)).otherwise(F.col(q)).alias(name)
    edges = scratch.save(x.select(first("b", "a", "late"), first("at_b", "at_a", "late_at"), first("a", "b", "early"), first("at_a", "at_b", "early_at")).distinct())
    kind = item.schema["item_id"].dataType.simpleString()
    open_, left, taken = edges, edges.count(), []

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        for end in ("late", "early"):
            rows = rows.join(gone.withColumnRenamed("late", end), end, "left_anti")
        return rows.select(*edges.columns)

    while left:
        founders = open_.select("early").distinct().join(open_.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
        founders = scratch.save(founders, slim=True)
        took = scratch.save(open_.join(founders, "early", "left_semi").select("late").distinct(), slim=True)
        taken.append(took)
        nxt = scratch.save(without(open_, took))
        n = nxt.count()
        if n and (n <= block_edges or n > 0.8 * left):
            took = scratch.save(nxt.orderBy("late_at", "late").limit(block_edges).select("late", "early").mapInPandas(_taken_in_order, f"late {kind}"))
            taken.append(took)
            block, nxt = nxt, scratch.save(without(nxt, took))
            scratch.drop(block)
            n = nxt.count()
        scratch.drop(founders, *([open_] if open_ is not edges else []))
        open_, left = nxt, n
    if not taken:
        return item.select("item_id", F.col("item_id").alias("group_id"))
    gone = taken[0]
    for more in taken[1:]:
        gone = gone.unionByName(more)
    gone = scratch.save(gone.distinct(), slim=True)
    founders = item.join(gone.withColumnRenamed("late", "item_id"), "item_id", "left_anti")
    # a founder's partners are all taken; those that come before it are of an earlier one
    own = edges.unionByName(edges.selectExpr("early as late", "early_at as late_at", "late as early", "late_at as early_at")).join(founders.select(F.col("item_id").alias("early")), "early", "left_semi")
    best = own.groupBy(F.col("late").alias("item_id")).agg(F.min(F.struct("early_at", "early")).alias("g"))
    return item.join(best, "item_id", "left").select("item_id", F.coalesce("g.early", "item_id").alias("group_id"))


def two_stage_groups(items: DataFrame, blocks: DataFrame, fine_pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """Fine pairs count only within a coarse group (item_id, group_id); components of what is left."""
    a = blocks.select(F.col("item_id").alias("a"), F.col("group_id").alias("ga"))
    b = blocks.select(F.col("item_id").alias("b"), F.col("group_id").alias("gb"))
    return similarity_groups(items, fine_pairs.join(a, "a").join(b, "b").where("ga = gb").select("a", "b"), id_col)


def by_class(items: DataFrame, key: str, group, id_col: str = "id") -> DataFrame:
    """Groups of rows, from those of their classes: rows of one `key` are one class, named by its smallest id.

    `group` takes the classes (id, key, n = rows) and returns (item_id, ...); each row gets what its class got. Right where
    equal rows are partners, as then a class is never divided: its rows have the same partners, and an order by id meets its first row first.
    """
    classes = Scratch(items.sparkSession, "classes").save(items.groupBy(key).agg(F.min(id_col).alias("id"), F.count("*").alias("n")))
    member = items.join(classes.select(key, F.col("id").alias("_rep")), key).select(F.col(id_col).alias("_id"), "_rep")
    found = group(classes).withColumnRenamed("item_id", "_rep")
    return member.join(found, "_rep").drop("_rep").withColumnRenamed("_id", "item_id")


def density_clusters(items: DataFrame, pairs: DataFrame, id_col: str = "id", min_samples: int = 2, n_col: str | None = None) -> DataFrame:
    """(item_id, label): density clustering over the pairs' graph.

    An item with at least min_samples - 1 partners is a core; connected cores make a cluster, labelled by its smallest core; other
    items take their smallest core partner's label; the rest is noise, label null here and -1 in `labelled`. With `n_col` an item
    stands for that many equal ones, which are partners of each other.
    """
    e = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("x", "y").distinct()
    if n_col is None:
        core = e.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples - 1).select("x")
    else:
        size = items.select(F.col(id_col).alias("y"), F.col(n_col).alias("n"))
        met = e.join(size, "y").select("x", "n").unionByName(size.select(F.col("y").alias("x"), (F.col("n") - 1).alias("n")))
        core = met.groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples - 1).select("x")
    among = e.join(core, "x", "left_semi").join(core.withColumnRenamed("x", "y"), "y", "left_semi")
    comp = similarity_groups(core.withColumnRenamed("x", "id"), among.select(F.col("x").alias("a"), F.col("y").alias("b")))
    border = e.join(core, "x", "left_anti").join(comp.withColumnRenamed("item_id", "y"), "y").groupBy(F.col("x").alias("item_id")).agg(F.min("group_id").alias("group_id"))
    found = comp.unionByName(border)
    return items.select(F.col(id_col).alias("item_id")).join(found, "item_id", "left").withColumnRenamed("group_id", "label")


def labelled(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("label", F.coalesce(F.col("label").cast("long"), F.lit(-1).cast("long")))
