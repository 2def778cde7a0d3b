"""Files, presets, virtual folders, and the sinks of curation results."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.rules import DimensionRule
from siftmill.functions.uris import is_image


def scan_images(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """(path, size, mtime[, content]) of image files under a folder, each once, by extension in any case."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(is_image(F.col("path")))
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if with_content else []))


def load_rules(text: str) -> list[DimensionRule]:
    """Dimension rules of a preset's JSON: `dimension_rules`, or the older `width_ranges` of [min, max, folder]."""
    data = json.loads(text)
    if "dimension_rules" in data:
        return [DimensionRule(r.get("folder", ""), *(int(r.get(k, -1)) for k in ("min_width", "max_width", "min_height", "max_height")), r.get("mode", "and")) for r in data["dimension_rules"]]
    return [DimensionRule(str(f), int(lo), int(hi)) for lo, hi, f in data.get("width_ranges", ())]


def virtual_folders(tree: dict) -> list[str]:
    """Paths of a folder tree's nodes that are packed as a whole or in part and hold images or archives."""

    def walk(node: dict) -> Iterator[str]:
        kinds = node.get("file_types") or {}
        if node.get("compress_mode") in ("entire", "selective") and (kinds.get("image", 0) > 0 or kinds.get("archive", 0) > 0):
            yield node["path"] + ".folderzip"
        for child in node.get("children") or ():
            yield from walk(child)

    return list(walk(tree))


def main_files(files: DataFrame, info: DataFrame, name: str = "name") -> DataFrame:
    """Files without those that a group's info (name, type, is_main) calls trash, or multi without being the main one."""
    bad = info.where("type = 'trash' OR (type = 'multi' AND NOT is_main)").select(F.col("name").alias("_n"))
    return files.join(bad, F.col(name) == F.col("_n"), "left_anti")


def read_vectors(spark: SparkSession, path: str, valid: DataFrame | None = None) -> DataFrame:
    """(path, hash_vector array<float>...) of a feature table, only of paths that are still valid where these are given."""
    t = spark.read.parquet(path)
    return t if valid is None else t.join(valid.select(F.col("path").alias("_v")), F.col("path") == F.col("_v"), "left_semi")


def write_decisions(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("overwrite").partitionBy("reason").parquet(path)


def write_groups(groups: DataFrame, path: str, name: str = "name") -> None:
    """Three tables: all groups, the first of each by name to keep, and the rest to delete."""
    from siftmill.operators.ranking import keep_first

    ranked = keep_first(groups, "group_id", [F.lower(name)])
    ranked.write.mode("overwrite").parquet(f"{path}/ranked")
    ranked = groups.sparkSession.read.parquet(f"{path}/ranked")
    ranked.drop("rank").write.mode("overwrite").json(f"{path}/groups")
    ranked.where("rank = 1").select(name).write.mode("overwrite").text(f"{path}/keep")
    ranked.where("rank > 1").select(name).write.mode("overwrite").text(f"{path}/delete")


def write_pairs(pairs: DataFrame, path: str, by: str = "hash_size") -> None:
    """Pairs by distance, one folder of CSV files per `by`, and a summary next to them."""
    from siftmill.operators.similarity import distance_stats

    pairs.sortWithinPartitions("distance", "a", "b").write.mode("overwrite").partitionBy(by).option("header", True).csv(f"{path}/pairs")
    distance_stats(pairs, (by,)).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def report(summary: DataFrame) -> DataFrame:
    """(line): a Markdown list of a summary row's numbers."""
    items = F.array(*[F.concat(F.lit(f"- {c.replace('_', ' ')}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in summary.columns])
    return summary.select(F.explode(items).alias("line"))


def target_path(items: DataFrame, root: str, folder: str, relative: str) -> DataFrame:
    return items.withColumn("dst_path", F.concat_ws("/", F.lit(root), F.col(folder), F.col(relative)))
