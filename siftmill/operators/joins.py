"""Small set and path joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_there_yet(source: DataFrame, target: DataFrame, name: str = "name") -> DataFrame:
    """Rows of `source` whose name, in any case, is not in `target`."""
    t = target.select(F.lower(name).alias("_n")).distinct()
    return source.join(t, F.lower(F.col(name)) == F.col("_n"), "left_anti")


def path_prefixes(path: Column) -> Column:
    """array<struct<folder, depth>> of all folders above a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("folder"), i.alias("depth")))


def nearest_folder(items: DataFrame, folders: DataFrame, path: str = "path", folder: str = "folder", marked: str = r"\[[^\[\]]+\]") -> DataFrame:
    """(items..., folder): the deepest of the given folders above a path whose name has a bracketed part; null for none."""
    pre = items.select(F.col(path).alias("_p"), F.explode(path_prefixes(F.col(path))).alias("_f")).distinct()
    good = folders.where(F.regexp_extract(folder, r"([^/]*)$", 1).rlike(marked)).select(F.col(folder).alias("_g")).distinct()
    best = pre.join(good, F.col("_f.folder") == F.col("_g")).groupBy("_p").agg(F.max(F.struct("_f.depth", "_g")).alias("_m"))
    return items.join(best, F.col(path) == F.col("_p"), "left").select(*[F.col(c) for c in items.columns], F.col("_m._g").alias("folder"))


def union_decisions(*stages: DataFrame) -> DataFrame:
    """One decision per item; of several the one of the last stage given."""
    x = None
    for i, s in enumerate(stages):
        s = s.select("item_id", "stage", "reason").withColumn("_i", F.lit(i))
        x = s if x is None else x.unionByName(s)
    return x.groupBy("item_id").agg(F.max(F.struct("_i", "stage", "reason")).alias("m")).select("item_id", "m.stage", "m.reason")


def one_folder(items: DataFrame, folder: str, group: str | None = None) -> DataFrame:
    """([group,] mergeable): whether all items, or all of a group, lie in one folder."""
    by = [F.col(group).alias("group")] if group else []
    return items.groupBy(*by).agg((F.count_distinct(folder) == 1).alias("mergeable"))
