"""Rule cascades over competing versions of one work: pruning and version resolution."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions import rules as R
from siftmill.functions.titles import title_key, version, without_version
from siftmill.functions.uris import base_name, extension, without_extension


@dataclass(frozen=True)
class PruneRule:
    """`version`: of a title with versions only the highest stays. `keyword`: names with (keep) or without (drop) a word stay.

    scope: `chinese`, `other` or `all`.
    """

    type: str
    keywords: tuple[str, ...] = ()
    scope: str = "all"
    keep_matching: bool = True


# The default rules, in order.
DEFAULT_RULES = (
    PruneRule("version"),
    PruneRule("keyword", ("[eve重嵌]",), "chinese", False),
    PruneRule("keyword", ("无修", "無修", "uncensor", "无码", "無碼", "去码"), "chinese", True),
    PruneRule("keyword", ("dl", "dlsite", "dl版", "DL", "DL版"), "chinese", True),
    PruneRule("keyword", ("官方", "简体中文", "简中", "简体", "数位", "數位"), "chinese", True),
    PruneRule("keyword", ("重嵌", "修图"), "chinese", True),
    PruneRule("keyword", ("第二版",), "chinese", True),
    PruneRule("keyword", ("广告", "镜面光折射", "禁漫"), "chinese", False),
    PruneRule("keyword", ("中国翻訳", "中国翻译", "中国翻譯", "机翻"), "chinese", False),
    PruneRule("keyword", ("無邪気", "葱鱼"), "chinese", False),
)


def prune(items: DataFrame, group: str, name: str, is_chinese: str, size: str, rules: Sequence[PruneRule] = DEFAULT_RULES, min_keep: int = 1, item: str = "item_id") -> DataFrame:
    """Adds `pruned_by`: the index of the rule that removed a row, null for rows that stay.

    Rules apply in order to what is left; a group of at most min_keep rows is left alone. A keyword rule is
    skipped in a group where it matches nothing in scope, where it would drop from min_keep rows or fewer in scope, or where it
    would leave fewer than min_keep rows. Every rule is one set of window counts over the group; all rules share its partitioning.
    """
    w = Window.partitionBy(group)
    low = F.lower(base_name(F.col(name)))
    x = items.withColumn("_low", low).withColumn("_total", F.count("*").over(w)).withColumn("pruned_by", F.lit(None).cast("int"))
    x = x.withColumn("_ver", F.coalesce(version(without_extension(F.col("_low"))), F.lit(1)))
    x = x.withColumn("_base", F.concat(F.lower(without_version(without_extension(F.col("_low")))), extension(F.col("_low"))))
    for i, rule in enumerate(rules):
        alive = F.col("pruned_by").isNull()
        n_alive = F.count_if(alive).over(w)
        if rule.type == "version":
            per = Window.partitionBy(group, "_base")
            top = F.max(F.when(alive, F.col("_ver"))).over(per)
            order = Window.partitionBy(group, "_base").orderBy(F.when(alive, 0).otherwise(1), F.desc("_ver"), F.desc_nulls_last(size), item)
            gone = alive & (F.col("_total") > min_keep) & (top >= 2) & (F.count_if(alive).over(per) > 1) & (F.row_number().over(order) > 1)
        else:
            scope = {"chinese": F.col(is_chinese), "other": ~F.col(is_chinese), "all": F.lit(True)}[rule.scope]
            match = R.has_keyword(F.col("_low"), list(rule.keywords), variants=False)
            hit = alive & scope & match
            going = alive & scope & (~match if rule.keep_matching else match)
            n_hit, n_scope, n_going = (F.count_if(c).over(w) for c in (hit, alive & scope, going))
            ok = (F.col("_total") > min_keep) & (n_hit > 0) & (n_alive - n_going >= min_keep)
            if not rule.keep_matching:
                ok = ok & (n_scope > min_keep)
            gone = going & ok
        x = x.withColumn("_gone", gone).withColumn("pruned_by", F.when(F.col("_gone"), F.lit(i)).otherwise(F.col("pruned_by"))).drop("_gone")
    return x.drop("_low", "_total", "_ver", "_base")


def resolve_versions(
    items: DataFrame, path: str, size: str, rules: Sequence[PruneRule] = DEFAULT_RULES, min_keep: int = 1, trash_only: bool = False, item: str = "item_id", key: Column | None = None
) -> DataFrame:
    """(group, item_id, action, is_main): what becomes of each file among others of its title.

    Blacklisted paths and titles with one file are `skip`. Where a title's Chinese versions include no original
    edition, original editions among the others count as Chinese. After pruning (`pruned`): several Chinese versions are all `multi` and the
    others `trash`; one is `keep` and the others `trash`; without any, several others are `multi`, a single one `keep`. With trash_only
    nothing becomes `multi`: these stay, as `keep`. `is_main` marks the largest of a title's multi files.
    """
    name = base_name(F.col(path))
    x = items.withColumn("_black", R.is_blacklisted(F.col(path))).withColumn("group", title_key(name) if key is None else key)
    w = Window.partitionBy("group", "_black")
    x = x.withColumn("_alone", F.col("_black") | (F.count("*").over(w) < 2))
    x = x.withColumn("_zh", R.is_chinese_version(F.col(path))).withColumn("_orig", R.is_original_version(F.col(path)))
    promoted = ~F.coalesce(F.bool_or(F.col("_zh") & F.col("_orig")).over(w), F.lit(False)) & F.col("_orig")
    x = x.withColumn("_zh", F.col("_zh") | promoted)
    skipped, x = x.where("_alone"), x.where("NOT _alone")
    x = prune(x, "group", path, "_zh", size, rules, min_keep, item)
    w = Window.partitionBy("group")
    left = F.col("pruned_by").isNull()
    n_zh, n_other = F.count_if(left & F.col("_zh")).over(w), F.count_if(left & ~F.col("_zh")).over(w)
    several = F.lit("keep" if trash_only else "multi")
    action = F.when(~left, "pruned").when(n_zh > 0, F.when(~F.col("_zh"), "trash").when(n_zh > 1, several).otherwise("keep")).when(n_other > 1, several).otherwise("keep")
    x = x.withColumn("action", action)
    main = F.row_number().over(Window.partitionBy("group", "action").orderBy(F.desc_nulls_last(size), item)) == 1
    out = x.select("group", F.col(item).alias("item_id"), "action", ((F.col("action") == "multi") & main).alias("is_main"))
    return out.unionByName(skipped.select("group", F.col(item).alias("item_id"), F.lit("skip").alias("action"), F.lit(False).alias("is_main")))
