"""Mixing sources to target weights.

Budgets flow down a domain - language - source tree. A leaf can give at most its tokens times the allowed epochs; what it
cannot give goes to its siblings first, and only what a whole subtree cannot give goes to the subtree's siblings. Each
leaf then gives a prefix, by tokens, of its rows in seeded order, epoch after epoch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.plans.scratch import Scratch

#: Times the rows that a bucket is meant to have, beyond which it is cut again.
CROWDED = 8

LEVELS = ("domain", "lang", "source")


def count_tokens(text: Column) -> Column:
    """The default token count: a quarter of the UTF-8 bytes, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def water_fill(total: float, children: Mapping[str, tuple[float, float]]) -> dict[str, float]:
    """Shares `total` among children (weight, capacity) by weight; what a full child leaves goes to the others."""
    got = dict.fromkeys(children, 0.0)
    open_ = {k for k, (w, cap) in children.items() if w > 0 and cap > 0}
    left = min(total, sum(children[k][1] for k in open_))
    while open_ and left > 1e-9:
        weight = sum(children[k][0] for k in open_)
        full = {k for k in open_ if got[k] + left * children[k][0] / weight >= children[k][1]}
        if not full:
            for k in open_:
                got[k] += left * children[k][0] / weight
            break
        for k in full:
            left -= children[k][1] - got[k]
            got[k] = children[k][1]
        open_ -= full
    return got


def budgets(leaves: Mapping[tuple, int], total: float, weights: Mapping[tuple, float], max_epochs: float) -> dict[tuple, int]:
    """Token budget of each leaf.

    `leaves`: path -> tokens there are. `weights`: path prefix -> weight among its siblings; a prefix without one
    weighs as many as the tokens below it. Budgets are whole tokens, rounded down.
    """
    capacity: dict[tuple, float] = {}
    tokens: dict[tuple, int] = {}
    below: dict[tuple, set[tuple]] = {}
    for path, n in leaves.items():
        for k in range(len(path) + 1):
            capacity[path[:k]] = capacity.get(path[:k], 0.0) + n * max_epochs
            tokens[path[:k]] = tokens.get(path[:k], 0) + n
            if k:
                below.setdefault(path[: k - 1], set()).add(path[:k])
    out: dict[tuple, int] = {}

    def give(node: tuple, amount: float) -> None:
        if node in leaves:
            out[node] = int(amount + 1e-6)
            return
        # A child's capacity is that of its whole subtree: shortages are settled among siblings below
        # before any of them comes up to this level.
        kids = sorted(below.get(node, ()), key=str)
        given = [w for k in kids if (w := weights.get(k)) is not None]
        # unstated weights: by tokens, scaled so that tokens and stated weights mix when both occur
        rest = sum(tokens[k] for k in kids if weights.get(k) is None) or 1
        spare = max(1.0 - sum(given), 0.0) if given else 1.0
        share = {k: weights[k] if weights.get(k) is not None else spare * tokens[k] / rest for k in kids}
        for k, v in water_fill(amount, {k: (share[k], capacity[k]) for k in kids}).items():
            give(k, v)

    if leaves:
        give((), min(total, capacity[()]))
    return out


def mix(
    docs: DataFrame,
    total_tokens: int | None,
    weights: Mapping[tuple, float],
    domain: Column,
    max_epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    tokens=count_tokens,
    rows_per_bucket: int = 2000,
    max_leaves: int = 100_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, domain, lang, source, epoch int, tokens long, start long, carry...): the selected rows.

    `total_tokens` None means all tokens once. In each epoch a leaf's rows stand in the order of the first 15 hex digits of md5(seed/epoch/id);
    `start` is the number of tokens before a row within its leaf, earlier epochs included, and a row is taken
    when start < budget: the last row may pass the budget, so no leaf with a budget stays below it.
    Prefix sums are taken in two steps: hash ranges of about `rows_per_bucket` rows are summed first. A range that holds
    far more, as rows of one id or of none stand in one place, is cut again by sampled quantiles of the whole order, so that neither a
    leaf nor an id, however many rows it has, is ever in one task. Epochs beyond what a budget needs are never made.

    Defined cases: null languages, sources and domains are leaves of their own (written "" in paths); null
    and empty texts have 0 tokens and come along when their turn is before the budget; rows with one id are ordered by
    their tokens and text hash; an empty table gives an empty result; columns of other names are ignored
    unless named in `carry`. The tree is a driver-side table of at most `max_leaves` leaves, more raise.
    """
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keep = [F.col(c).alias(f"c_{c}") for c in carry]
    src = docs.select(
        F.col(id_col).alias("id"), part(domain).alias("l0"), part(F.col(lang_col)).alias("l1"), part(F.col(source_col)).alias("l2"),
        tokens(F.col(text_col)).alias("tok"), F.xxhash64(F.col(text_col)).alias("tie"), *keep,
    )
    leaf = ["l0", "l1", "l2"]
    spark = docs.sparkSession
    counted = src.groupBy(*leaf).agg(F.sum("tok").alias("n"), F.count("*").alias("rows")).limit(max_leaves + 1).collect()
    if len(counted) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    have = {(r.l0, r.l1, r.l2): int(r.n) for r in counted}
    rows = {(r.l0, r.l1, r.l2): int(r.rows) for r in counted}
    total = sum(have.values()) if total_tokens is None else total_tokens
    give = budgets(have, total, weights, max_epochs)
    plan = [(*k, e, min(b - e * have[k], have[k]), e * have[k], max(1, rows[k] // rows_per_bucket)) for k, b in give.items() if b > 0 for e in range(-(-b // have[k]))]
    table = spark.createDataFrame(plan, "l0 string, l1 string, l2 string, epoch int, want long, before long, buckets long")
    if len(plan) <= 2000:  # a checked bound; larger trees are joined by shuffle
        table = F.broadcast(table)
    x = src.join(table, leaf)
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("epoch"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    x = x.withColumn("order", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    # the order's leading part: equal ranges of digests, of which a leaf has as many as its rows need
    x = x.withColumn("bucket", F.floor(F.col("order").cast("double") / float(1 << 60) * F.col("buckets")))
    scratch, at = Scratch(spark, "mixing"), [*leaf, "epoch", "bucket"]
    counted = lambda rows, keys: rows.groupBy(*keys).agg(F.sum("tok").alias("s"), F.count("*").alias("c"))
    x = x.withColumn("sub", F.lit(0))
    sums = scratch.save(counted(x, [*at, "sub"]), slim=True)
    crowded = sums.where(F.col("c") > CROWDED * rows_per_bucket)
    if (n := crowded.agg(F.sum("c")).first()[0]) is not None:
        crowded = scratch.save(crowded.select(*at), slim=True)
        # equal rows may stand in any order, but must keep it: both the number and the place are written
        many = scratch.save(x.drop("sub").join(crowded, at, "left_semi").withColumn("salt", F.monotonically_increasing_id()))
        many = many.repartitionByRange(max(2, -(-n // rows_per_bucket)), *at, "order", "id", "tok", "tie", "salt")
        many = scratch.save(many.drop("salt").withColumn("sub", F.spark_partition_id()))
        x = x.join(crowded, at, "left_anti").unionByName(many)
        sums = scratch.save(counted(many, [*at, "sub"]).unionByName(sums.join(crowded, at, "left_anti")), slim=True)
    # prefix sums of bucket sums: again in two steps, by groups of 1024 buckets
    sums = sums.withColumn("block", F.floor(F.col("bucket") / 1024))
    blocks = sums.groupBy(*leaf, "epoch", "block").agg(F.sum("s").alias("bs"))
    wb = Window.partitionBy(*leaf, "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("b0", F.coalesce(F.sum("bs").over(wb), F.lit(0)))
    ws = Window.partitionBy(*leaf, "epoch", "block").orderBy("bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("s0", F.coalesce(F.sum("s").over(ws), F.lit(0))).join(blocks, [*leaf, "epoch", "block"]).select(*at, "sub", (F.col("s0") + F.col("b0")).alias("s0"))
    x = x.join(sums, [*at, "sub"])
    wi = Window.partitionBy(*at, "sub").orderBy("order", "id", "tok", "tie").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("start", F.col("s0") + F.coalesce(F.sum("tok").over(wi), F.lit(0))).where("start < want")
    return x.select(
        F.col("id").alias(id_col), F.col("l0").alias("domain"), F.col("l1").alias("lang"), F.col("l2").alias("source"), "epoch",
        F.col("tok").alias("tokens"), (F.col("start") + F.col("before")).alias("start"), *[F.col(f"c_{c}") for c in carry],
    )
