"""Exact duplicates without a group ever being in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_duplicates(items: DataFrame, key: Column, order: Column, item: str = "item_id", stage: str = "duplicate") -> DataFrame:
    """(item_id, stage, reason): all items of a key but the one that `order` puts last (the smallest id at a tie).

    The winner of each key is an aggregate with partial results before the shuffle; losers come from a join that AQE can split, so
    a key that holds a third of all rows is no hot spot. Items whose key is null stay.
    """
    x = items.select(F.col(item).alias("item_id"), key.alias("_k"), order.alias("_o")).where("_k IS NOT NULL")
    best = x.groupBy("_k").agg(F.max("_o").alias("_o"), F.count("*").alias("_n")).where("_n > 1")
    keep = x.join(best, ["_k", "_o"]).groupBy("_k").agg(F.min("item_id").alias("_keep"))
    j = x.join(keep, "_k").where("item_id <> _keep")
    return j.select("item_id", F.lit(stage).alias("stage"), F.concat(F.lit("copy of "), F.col("_keep").cast("string")).alias("reason"))
