"""Cascades: stages that each see what the ones before left, and give one decision per item that goes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions import rules as R
from siftmill.operators import fine, grouping, ranking, similarity
from siftmill.plans.scratch import Scratch

DECISION = ["item_id", "stage", "reason"]
#: A stage takes the items still there and returns decisions (item_id, stage, reason).
Stage = Callable[[DataFrame], DataFrame]


def predicate(stage: str, condition: Column, reason: Column | None = None, item: str = "item_id") -> Stage:
    reason = F.lit(stage) if reason is None else reason
    return lambda items: items.where(condition).select(F.col(item).alias("item_id"), F.lit(stage).alias("stage"), reason.alias("reason"))


def ranked(make: Callable[[DataFrame], DataFrame]) -> Stage:
    """A stage from a ranking operator, whose decisions carry their group too."""
    return lambda items: make(items).select(*DECISION)


def cascade(items: DataFrame, stages: Sequence[Stage], item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(decisions, survivors). Decisions of different stages are disjoint, and with the survivors they are the input.

    Every stage's decisions are written once: later stages and the survivors read them, and nothing is computed twice.
    An error in a stage is an error of the cascade.
    """
    scratch = Scratch(items.sparkSession, "cascade")
    left, made = items, None
    for stage in stages:
        d = scratch.save(stage(left).select(*DECISION).dropDuplicates(["item_id"]))
        made = d if made is None else made.unionByName(d)
        left = ranking.survivors(left, d, item)
    return made, left


def small_items(width: str, height: str, size: int = R.MIN_SIZE) -> Stage:
    return predicate("small_image", R.is_small_content(F.col(width), F.col(height), size))


def gray_items(flags: dict[str, str]) -> Stage:
    """`flags`: reason -> boolean column; reasons that hold are joined by `|`."""
    reason = F.concat_ws("|", *[F.when(F.col(c), r) for r, c in flags.items()])
    return predicate("grayscale", reason != "", reason)


def text_items(line_score: str, total: str, threshold: float) -> Stage:
    return predicate("text_image", (F.col(line_score) > 0) & (F.col(total) >= 4 * threshold), F.format_string("text score %.2f", F.col(total)))


def near_duplicates(chunks: str, bits: int, threshold: int, keep: Callable[[DataFrame], DataFrame], item: str = "item_id") -> Stage:
    """Groups by distance of fingerprints, then `keep` (a ranking operator over the column `group_id`) decides in each group."""

    def stage(items: DataFrame) -> DataFrame:
        fp = items.select(F.col(item).alias("id"), F.col(chunks).alias("chunks"))
        pairs = similarity.hamming_pairs(fp, threshold, bits)
        groups = grouping.groups_only(grouping.similarity_groups(fp, pairs))
        return keep(items.join(groups.withColumnRenamed("item_id", "_i"), F.col(item) == F.col("_i")).drop("_i")).select(*DECISION)

    return stage


def fine_duplicates(chunks: str, bits: int, threshold: int, least: float, keep: Callable[[DataFrame], DataFrame], thumb: str = "thumb", item: str = "item_id") -> Stage:
    """As `near_duplicates`, with a second look: in greedy groups of close fingerprints, pictures whose structural similarity is `least` or
    more are linked, and `keep` decides in each cluster. The reason is `cluster`, after what `keep` says."""

    def stage(items: DataFrame) -> DataFrame:
        scratch = Scratch(items.sparkSession, "fine-stage")
        fp = scratch.save(items.select(F.col(item).alias("id"), F.col(chunks).alias("chunks")))
        coarse = grouping.star_groups(fp, scratch.save(similarity.hamming_pairs(fp, threshold, bits)))
        x = items.select(F.col(item).alias("item_id"), F.col(thumb).alias("thumb")).join(coarse, "item_id")
        found = fine.fine_clusters(x, fine.fine_pairs(x, least)).where("cluster IS NOT NULL").select(F.col("item_id").alias("_i"), F.col("cluster").alias("group_id"))
        gone = keep(items.join(found, F.col(item) == F.col("_i")).drop("_i"))
        return gone.select("item_id", "stage", F.concat(F.lit("cluster: "), "reason").alias("reason"))

    return stage


def equal_duplicates(key: Column, keep: Callable[[DataFrame], DataFrame]) -> Stage:
    """As `near_duplicates`, for items of one key."""
    return lambda items: keep(items.withColumn("group_id", key).where("group_id IS NOT NULL")).select(*DECISION)


def reference_duplicates(reference: DataFrame, chunks: str, bits: int, threshold: int, item: str = "item_id", uri: str = "uri") -> Stage:
    """Items that have a reference within `threshold` go; the reason names the nearest."""

    def stage(items: DataFrame) -> DataFrame:
        x = items.select(F.col(item).alias("id"), F.col(chunks).alias("chunks"), F.col(uri).alias("uri"))
        m = similarity.reference_match(x, reference, threshold, bits)
        return m.select(F.col("id").alias("item_id"), F.lit("hash_duplicate").alias("stage"), F.format_string("%s (%d)", "ref_uri", "distance").alias("reason"))

    return stage


#: Group filters by name, as configurations give them; each makes a ranking from a config's parameters.
GROUP_FILTERS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {
    "time": lambda group="group_id", time="mtime": lambda x: ranking.newest(x, group, time),
    "size": lambda group="group_id", size="size": lambda x: ranking.largest(x, group, size, stage="size"),
    "ocr": lambda group="group_id", language="language", density="density", count="count", size="size": lambda x: ranking.by_language(x, group, language, density, count, size),
    "watermark": lambda group="group_id", marked="marked": lambda x: ranking.watermarked(x, group, marked),
    "comprehensive": lambda group="group_id", pixels="pixels", size="size", name="name", reverse=False: lambda x: ranking.progressive(
        x, group, [("size-tier", F.col(pixels), True), ("bytes-tier", F.col(size), True), ("name-tier", F.lower(name), reverse)]
    ),
}


def group_filter(config: str | dict | Sequence | None) -> Stage:
    """A stage from a configuration: None (keeps all), a name, `a_b` for a then b, {type, params}, or a list of these.

    Unknown names raise. In a list each filter sees what the ones before left.
    """
    if config is None:
        return lambda items: items.where("false").select(F.col("item_id"), F.lit("").alias("stage"), F.lit("").alias("reason"))
    if isinstance(config, str):
        names = [config] if config in GROUP_FILTERS else config.removeprefix("hybrid_").split("_")
        config = [{"type": n} for n in names]
    if isinstance(config, dict):
        config = [config]
    stages = []
    for c in config:
        c = {"type": c} if isinstance(c, str) else c
        if c["type"] not in GROUP_FILTERS:
            raise ValueError(f"no group filter named {c['type']!r}; there are {', '.join(sorted(GROUP_FILTERS))}")
        stages.append(ranked(GROUP_FILTERS[c["type"]](**c.get("params", {}))))
    return lambda items: cascade(items, stages)[0]
