"""Which item of a group stays, and why the others go.

All operators return decisions: (group, item_id, stage, reason[, details]), one row per item that goes.
Groups are window partitions; the sort columns end in the item's id, so results do not depend on input order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGE_FIRST = {"chinese": 0, "unknown": 1, "english": 2, "japanese": 3}
LANGUAGE_BEST = {"chinese": 0, "english": 1, "japanese": 2, "unknown": 3}


def _rank(order: dict[str, int], c: Column) -> Column:
    out = F.lit(len(order))
    for k, v in order.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _time(c: str) -> Column:
    return F.col(c).cast("timestamp")  # times may come without a zone


def keep_first(items: DataFrame, group: str, order: Sequence[Column], item: str = "item_id") -> DataFrame:
    """All rows with `rank` 1, 2... in their group."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order, item)))


def beside_winner(items: DataFrame, group: str, order: Sequence[Column], item: str, values: dict[str, Column]) -> DataFrame:
    """Rows with the winner of their group: `_w` (its item) and `values` of it, under the given names.

    The winner is a row_number() = 1, which Spark limits per group before the shuffle, and comes back by a join that AQE can split:
    a group that holds a large part of all rows is no hot spot.
    """
    w = Window.partitionBy(group).orderBy(*order, item)
    best = items.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    best = best.select(F.col(group).alias("_g"), F.col(item).alias("_w"), *[v.alias(n) for n, v in values.items()])
    return items.join(best, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def losers(items: DataFrame, group: str, order: Sequence[Column], stage: str, reason: Column, item: str = "item_id", values: dict[str, Column] | None = None) -> DataFrame:
    """All rows but each group's first; `reason` may use `values` of the winner."""
    x = beside_winner(items, group, order, item, values or {}).where(F.col(item) != F.col("_w"))
    return x.select(F.col(group).alias("group"), F.col(item).alias("item_id"), F.lit(stage).alias("stage"), reason.alias("reason"))


def progressive(items: DataFrame, group: str, tiers: Sequence[tuple[str, Column, bool]], item: str = "item_id", stage: str = "comprehensive") -> DataFrame:
    """Tier after tier, only the best stay: `tiers` are (reason, value, largest wins). What none of them decides stays.

    A number that is 0 or null in all of a group's rows still standing decides nothing, as equal values decide nothing. A loser's reason is
    the first tier in which it is behind the winner. The last tier should be unique (a name) for one row to stay.
    """
    cols = [f"_t{i}" for i in range(len(tiers))]
    x = items
    for c, (_, value, _) in zip(cols, tiers, strict=True):
        x = x.withColumn(c, value)
    order = [F.desc_nulls_last(c) if up else F.asc_nulls_last(c) for c, (_, _, up) in zip(cols, tiers, strict=True)]
    x = beside_winner(x, group, order, item, {f"{c}_best": F.col(c) for c in cols})
    behind = [~F.col(c).eqNullSafe(F.col(f"{c}_best")) for c in cols]
    reason = F.coalesce(*[F.when(b, F.lit(name)) for b, (name, _, _) in zip(behind, tiers, strict=True)])
    return x.withColumn("reason", reason).where("reason IS NOT NULL").select(F.col(group).alias("group"), F.col(item).alias("item_id"), F.lit(stage).alias("stage"), "reason")


def newest(items: DataFrame, group: str, time: str, item: str = "item_id") -> DataFrame:
    """The newest stays; reason: whole seconds older."""
    seconds = F.floor(F.unix_micros("_newest") / 1_000_000 - F.unix_micros(_time(time)) / 1_000_000).cast("long").cast("string")
    return losers(items, group, [F.desc_nulls_last(time)], "time", F.concat(seconds, F.lit(" s older")), item, {"_newest": _time(time)})


def largest(items: DataFrame, group: str, size: str, item: str = "item_id", stage: str = "quality") -> DataFrame:
    """The largest stays; reason: the bytes it is smaller by."""
    less = (F.col("_largest") - F.coalesce(F.col(size), F.lit(0))).cast("long").cast("string")
    return losers(items, group, [F.desc_nulls_last(size)], stage, F.concat(less, F.lit(" smaller")), item, {"_largest": F.col(size)})


def by_language(items: DataFrame, group: str, language: str, density: str, count: str, size: str, item: str = "item_id") -> DataFrame:
    """One language stays per group, in the order chinese, unknown, english, japanese; of chinese rows the densest, then
    the one with most text, of the others the largest."""
    first = _rank(LANGUAGE_FIRST, F.col(language))
    zh = F.col(language) == "chinese"
    order = [first, F.when(zh, F.col(density)).desc_nulls_last(), F.when(zh, F.col(count)).desc_nulls_last(), F.when(~zh, F.col(size)).desc_nulls_last()]
    return losers(items, group, order, "ocr", F.concat(F.lit("language "), F.col(language)), item)


def best_by_language(items: DataFrame, group: str, language: str, density: str, count: str, item: str = "item_id") -> DataFrame:
    """(group, item_id): the best row, in the order chinese, english, japanese, unknown, then by density and count."""
    return keep_first(items, group, [_rank(LANGUAGE_BEST, F.col(language)), F.desc_nulls_last(density), F.desc_nulls_last(count)], item).where("rank = 1").select(
        F.col(group).alias("group"), F.col(item).alias("item_id")
    )


def watermarked(items: DataFrame, group: str, marked: str, item: str = "item_id") -> DataFrame:
    """Marked rows go where the group has a clean one; where it has none, nothing goes."""
    clean = items.where(~F.col(marked)).select(F.col(group).alias("_g")).distinct()
    x = items.where(marked).join(clean, F.col(group).eqNullSafe(F.col("_g")), "left_semi")
    return x.select(F.col(group).alias("group"), F.col(item).alias("item_id"), F.lit("watermark").alias("stage"), F.lit("watermark").alias("reason"))


def earliest_or_rename(items: DataFrame, group: str, time: str, digest: str, item: str = "item_id") -> DataFrame:
    """(group, item_id, action, n): the earliest is kept; rows with its digest are `trash`, others are `rename` with a number."""
    w = Window.partitionBy(group).orderBy(F.asc_nulls_last(time), item)
    x = items.withColumn("_first", F.first(digest).over(w)).withColumn("_rank", F.row_number().over(w))
    action = F.when(F.col("_rank") == 1, "keep").when(F.col(digest).eqNullSafe(F.col("_first")), "trash").otherwise("rename")
    x = x.withColumn("action", action)
    n = F.sum(F.when(F.col("action") == "rename", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.select(F.col(group).alias("group"), F.col(item).alias("item_id"), "action", F.when(F.col("action") == "rename", n).otherwise(0).cast("long").alias("n"))


def collision_numbers(items: DataFrame, name: str, item: str = "item_id") -> DataFrame:
    """`n` 0 for the first row of a name, 1, 2... for the next."""
    return items.withColumn("n", F.row_number().over(Window.partitionBy(name).orderBy(item)) - 1)


def newest_version(items: DataFrame, group: str, version: str, size: str, item: str = "item_id") -> DataFrame:
    """The highest version stays, the largest row at a tie; no version is version 1; groups without a version above 1 keep all."""
    x = items.withColumn("_v", F.coalesce(version, F.lit(1)))
    reason = F.when(F.col("_top") >= 2, F.concat(F.lit("v"), F.col("_v").cast("string"), F.lit(" < v"), F.col("_top").cast("string")))
    return losers(x, group, [F.desc("_v"), F.desc_nulls_last(size)], "version", reason, item, {"_top": F.col("_v")}).where("reason IS NOT NULL")


def sample_by_size(items: DataFrame, group: str, size: str, k: int = 3, item: str = "item_id") -> DataFrame:
    """The largest row, the middle one by size (of more than two), and rows of the top third in the order of the MD5 of their ids, k at most in all."""
    w = Window.partitionBy(group)
    x = items.withColumn("_r", F.row_number().over(w.orderBy(F.desc_nulls_last(size), item))).withColumn("_n", F.count("*").over(w))
    fixed = (F.col("_r") == 1) | ((F.col("_n") > 2) & (F.col("_r") == F.floor(F.col("_n") / 2) + 1))
    pool = F.col("_r") <= F.greatest(F.lit(3), F.floor(F.col("_n") / 3))
    x = x.withColumn("_p", F.when(fixed, 0).when(pool, 1).otherwise(2)).where("_p < 2")
    pick = Window.partitionBy(group).orderBy("_p", F.when(F.col("_p") == 0, F.col("_r")), F.md5(F.col(item).cast("string")), item)
    return x.withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= k).select(F.col(group).alias("group"), F.col(item).alias("item_id"), "pick")


def spread_sample(items: DataFrame, group: str, order: Column, head: int = 5, middle: int = 12, tail: int = 3, item: str = "item_id") -> DataFrame:
    """The first `head` rows, the last `tail`, and `middle` evenly spaced ones between; all of a group that has no more."""
    w = Window.partitionBy(group)
    x = items.withColumn("rank", F.row_number().over(w.orderBy(order, item))).withColumn("_n", F.count("*").over(w))
    inner = F.col("_n") - head - tail
    at = F.col("rank") - head - 1  # 0-based place between
    # a place is chosen where the scaled place reaches a new whole number
    chosen = F.floor(at * middle / inner) != F.floor((at - 1) * middle / inner)
    keep = (F.col("rank") <= head) | (F.col("rank") > F.col("_n") - tail) | (inner <= middle) | chosen
    return x.where(keep).select(F.col(group).alias("group"), F.col(item).alias("item_id"), "rank")


def select_indices(items: DataFrame, group: str, order: Column, front: int | None = None, back: int | None = None, start: int | None = None, stop: int | None = None, item: str = "item_id") -> DataFrame:
    """Rows with 0-based `index`: the first `front` and last `back`, or start <= index < stop; all if nothing is asked."""
    w = Window.partitionBy(group)
    x = items.withColumn("index", F.row_number().over(w.orderBy(order, item)) - 1).withColumn("_n", F.count("*").over(w))
    keep = F.lit(front is None and back is None and start is None and stop is None)
    if front is not None:
        keep = keep | (F.col("index") < front)
    if back is not None:
        keep = keep | (F.col("index") >= F.col("_n") - back)
    if start is not None or stop is not None:
        keep = keep | ((F.col("index") >= (start or 0)) & (F.lit(stop is None) | (F.col("index") < (stop or 0))))
    return x.where(keep).drop("_n")


def bounded_removal(items: DataFrame, group: str, score: str, thresholds: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), max_keep: int = 20, keep_share: float = 0.2, item: str = "item_id") -> DataFrame:
    """(group, item_id, score, threshold): rows at or above the lowest threshold that does not remove too many.

    A group of n may lose max(n - max_keep, n - int((1 - keep_share) * n)) rows, never fewer than 0. Where every threshold removes more, the
    top rows by score go, as many as may, with a null threshold.
    """
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    # the share is counted in whole rows: int(0.8 n) as integer arithmetic, so that no engine rounds it differently
    share = F.floor(n * round((1 - keep_share) * 1000) / 1000)
    x = items.withColumn("_cap", F.greatest(n - max_keep, n - share, F.lit(0)))
    x = x.withColumn("_t", F.coalesce(*[F.when(F.sum(F.when(F.col(score) >= t, 1).otherwise(0)).over(w) <= F.col("_cap"), F.lit(float(t))) for t in thresholds]))
    x = x.withColumn("_r", F.row_number().over(w.orderBy(F.desc_nulls_last(score), item)))
    gone = F.when(F.col("_t").isNotNull(), F.col(score) >= F.col("_t")).otherwise(F.col("_r") <= F.col("_cap"))
    return x.where(gone).select(F.col(group).alias("group"), F.col(item).alias("item_id"), F.col(score).alias("score"), F.col("_t").alias("threshold"))


def islands(items: DataFrame, order: Column, inside: Column, group: Column | None = None) -> DataFrame:
    """Adds `island`: consecutive rows for which `inside` holds share a number, other rows have null.

    Without `group` the order is over all rows, by definition in one task; give the parent folder as `group` where runs end at folders.
    """
    w = Window.partitionBy(group if group is not None else F.lit(0)).orderBy(order)
    return items.withColumn("_out", F.sum(F.when(inside, 0).otherwise(1)).over(w)).withColumn("island", F.when(inside, F.col("_out"))).drop("_out")


def sessions(items: DataFrame, key: str, time: str, gap_seconds: float) -> DataFrame:
    """Adds `session`: 1, 2... per key; a gap of more than `gap_seconds` begins a new one."""
    w = Window.partitionBy(key).orderBy(time)
    gap = (F.unix_micros(_time(time)) - F.unix_micros(F.lag(_time(time)).over(w))) > int(gap_seconds * 1_000_000)
    return items.withColumn("session", F.sum(F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).over(w))


def line_uniformity(lines: DataFrame, group: str, top: str, height: str) -> DataFrame:
    """(group, n_lines, uniformity): 1 - min(1, variance / mean squared) of the gaps between lines from top to bottom."""
    w = Window.partitionBy(group).orderBy(top)
    g = lines.withColumn("_gap", F.col(top) - F.lag(F.col(top) + F.col(height)).over(w))
    stat = g.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n_lines"), F.var_pop("_gap").alias("_v"), F.avg("_gap").alias("_m"))
    return stat.select("group", "n_lines", F.when(F.col("_m") > 0, 1 - F.least(F.lit(1.0), F.col("_v") / (F.col("_m") * F.col("_m")))).otherwise(0.0).alias("uniformity"))


def group_number(name: Column, modulo: int = 10000) -> Column:
    """A stable number for a name, the same in every run."""
    return F.pmod(F.xxhash64(name), F.lit(modulo)).cast("int")


def survivors(items: DataFrame, decisions: DataFrame, item: str = "item_id") -> DataFrame:
    return items.join(decisions.select(F.col("item_id").alias("_gone")), F.col(item) == F.col("_gone"), "left_anti")
