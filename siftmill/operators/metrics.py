"""Aggregations over items, archives and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.rules import DimensionRule, first_rule


def upper_median(name: str) -> Column:
    """An aggregate over the column `name`: the element at n // 2 of the sorted values, so 3 of 1, 2, 3, 4.

    It keeps counts of distinct values, partially before the shuffle, not the values. Nulls do not count.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def positive_mean(value: Column) -> Column:
    """An aggregate: the mean of values above 0; null without any."""
    return F.avg(F.when(value > 0, value))


def group_best(items: DataFrame, group: str, width: str = "width", pages: str = "pages", clarity: str = "clarity", fewest_pages: bool = True) -> DataFrame:
    """Best metrics of each group: largest width and clarity, least positive page count (or largest), and whether all positive values are the same."""
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    best_pages = F.min(pos(pages)) if fewest_pages else F.max(pos(pages))
    same = lambda c: (F.count_distinct(pos(c)) <= 1)
    return items.groupBy(F.col(group).alias("group")).agg(
        F.max(pos(width)).alias("best_width"), best_pages.alias("best_pages"), F.max(pos(clarity)).alias("best_clarity"),
        same(width).alias("same_width"), same(pages).alias("same_pages"), same(clarity).alias("same_clarity"),
    )


def group_owners(items: DataFrame, group: str, item: str, metrics: Sequence[str]) -> DataFrame:
    """(group, metric, owner, value): who has the largest value of each metric that is not the same for all; first item at a tie."""
    aggs = []
    for m in metrics:
        # the largest value, then the smallest item: min over the negated value
        aggs += [F.min(F.when(F.col(m).isNotNull(), F.struct((-F.col(m)).alias("v"), F.col(item).alias("o")))).alias(f"_{m}"), F.count_distinct(m).alias(f"_n_{m}")]
    g = items.groupBy(F.col(group).alias("group")).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_{m}.o").alias("owner"), (-F.col(f"_{m}.v")).cast("double").alias("value"), F.col(f"_n_{m}").alias("n")) for m in metrics]))
    return g.select("group", rows.alias("r")).where("r.n > 1").select("group", "r.metric", "r.owner", "r.value")


def dimension_router(items: DataFrame, archive: str, width: str, height: str, rules: list[DimensionRule], threshold_count: int = 1) -> DataFrame:
    """(archive, n_items, avg_width, avg_height, rule, rule_count, folder): the rule most items of an archive match first; the
    earlier rule at a tie. Archives in which no rule has `threshold_count` items have a null rule."""
    x = items.withColumn("_rule", first_rule(F.col(width), F.col(height), rules))
    by_rule = x.groupBy(archive, "_rule").agg(F.count("*").alias("c"), F.sum(width).alias("w"), F.sum(height).alias("h"))
    hit = F.when(F.col("_rule").isNotNull() & (F.col("c") >= threshold_count), F.struct(F.col("c"), (-F.col("_rule")).alias("r")))
    g = by_rule.groupBy(F.col(archive).alias("archive")).agg(F.sum("c").alias("n_items"), F.sum("w").alias("_w"), F.sum("h").alias("_h"), F.max(hit).alias("_m"))
    rule = -F.col("_m.r")
    folder = F.coalesce(*[F.when(rule == i, F.lit(r.folder)) for i, r in enumerate(rules)])
    return g.select("archive", "n_items", (F.col("_w") / F.col("n_items")).alias("avg_width"), (F.col("_h") / F.col("n_items")).alias("avg_height"), rule.alias("rule"), F.col("_m.c").alias("rule_count"), folder.alias("folder"))


def guarded_removals(items: DataFrame, group: str, doomed: Column, limit: float = 0.5, countable: Column | None = None) -> DataFrame:
    """Rows to remove, of groups in which they are no more than `limit` of the countable rows."""
    countable = F.lit(True) if countable is None else countable
    share = items.groupBy(group).agg(F.count_if(doomed).alias("_d"), F.count_if(countable).alias("_n")).where((F.col("_d") > 0) & (F.col("_d") <= F.col("_n") * limit))
    return items.where(doomed).join(share.select(group), group, "left_semi")


def timing(rows: DataFrame, by: Sequence[str], seconds: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.avg(seconds).alias("mean_time"), F.stddev_pop(seconds).alias("std_time"), F.min(seconds).alias("min_time"), F.max(seconds).alias("max_time"),
        F.median(seconds).alias("median_time"), (F.count(seconds) / F.sum(seconds)).alias("per_second"),
    )


def score_stats(rows: DataFrame, by: str, score: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.median(score).alias("median_score"))


def pivot_scores(rows: DataFrame, key: str, algorithm: str, score: str, algorithms: Sequence[str]) -> DataFrame:
    """One column per algorithm; the least score where a key has several."""
    return rows.groupBy(key).pivot(algorithm, list(algorithms)).agg(F.min(score))


def correlations(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, correlation) of all pairs of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs])).alias("r")).select("r.*")


def run_summary(rows: DataFrame, status: str, amount: str | None = None) -> DataFrame:
    """(n, n_success, n_failed, n_skipped[, total]) of a run's rows."""
    c = lambda v: F.count_if(F.col(status) == v)
    return rows.agg(F.count("*").alias("n"), c("success").alias("n_success"), c("failed").alias("n_failed"), c("skipped").alias("n_skipped"), *([F.sum(amount).alias("total")] if amount else []))


def hit_rate(rows: DataFrame, hit: Column) -> DataFrame:
    return rows.agg(F.avg(hit.cast("int")).alias("hit_rate"))


def duplicate_names(rows: DataFrame, name: Column) -> DataFrame:
    """(name, n) of names that occur more than once."""
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).where("n > 1")
