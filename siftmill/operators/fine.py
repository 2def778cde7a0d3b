"""Fine metric inside coarse groups: structural similarity of pictures, clusters of what is alike, and their medoids.

Coarse groups come from fingerprints; within them every pair of different pictures is compared, as the metric has no index, but a bound that is one
product of matrices rules nearly all out that are not alike, and only the others are scored. Pictures travel as thumbnails, once per pair of blocks, and
a task holds two blocks, whatever a group's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators import grouping
from siftmill.plans.scratch import Scratch

#: Pictures of a block.
BLOCK = 512
#: Pictures whose moments are held at once, and those that are worked on at once.
TILE, FEW = 64, 8
#: More than what 32-bit products of outlines may be off.
SLACK = 1e-4
#: The constants of structural similarity, for pictures in 0 to 1.
C1, C2 = 0.01**2, 0.03**2


def _blur(side: int) -> np.ndarray:
    """(side - 10, side): Gaussian window 11, sigma 1.5, without an edge."""
    k = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    out = np.zeros((side - 10, side))
    for i in range(side - 10):
        out[i, i : i + 11] = k / k.sum()
    return out


def _moments(x: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance in each window of each picture."""
    mean = k @ x @ k.T
    return mean, k @ (x * x) @ k.T - mean**2


def _scored(x: np.ndarray, mx: np.ndarray, vx: np.ndarray, y: np.ndarray, my: np.ndarray, vy: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Structural similarities of pictures x and y with their moments, one with the other or one with each, few at a time so that they stay in the cache."""
    out = np.empty(len(y))
    for i in range(0, len(y), FEW):
        at = slice(i, i + FEW)
        p, m, v = (x, mx, vx) if len(x) == 1 else (x[at], mx[at], vx[at])
        means = m * my[at]
        cov = k @ (p * y[at]) @ k.T
        cov -= means
        cov *= 2
        cov += C2
        means *= 2
        means += C1
        cov *= means
        size, spread = m**2 + my[at] ** 2, v + vy[at]
        size += C1
        spread += C2
        size *= spread
        cov /= size
        out[at] = cov.mean((1, 2))
    return out


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) structural similarities of pictures (n, side, side) in 0 to 1: every pair whole, what `alike` is tested against."""
    k = _blur(a.shape[1])
    (ma, va), (mb, vb) = _moments(a, k), _moments(b, k)
    return np.stack([_scored(a[i : i + 1], ma[i : i + 1], va[i : i + 1], b, mb, vb, k) for i in range(len(a))]) if len(a) else np.empty((0, len(b)))


def outlines(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, side * side) float32 images of pictures, and what of each they leave out: `at_most` bounds similarities by their products.

    A picture's windows, each less its mean and over its deviation, make a vector of length 1, and products of two such vectors are mean
    correlations over windows. Of such a vector the outline is the part that comes from one image whose pixels all windows over them share.
    """
    k = _blur(x.shape[1])
    cover = np.sqrt(np.outer(k.sum(0), k.sum(0)) * len(k) ** 2)
    out = np.empty((len(x), x.shape[1] ** 2), np.float32)
    for i in range(0, len(x), FEW):
        p = x[i : i + FEW]
        mean, var = _moments(p, k)
        r = 1 / np.sqrt(np.maximum(var, 0) + C2 / 2)
        out[i : i + FEW] = ((p * (k.T @ r @ k) - k.T @ (mean * r) @ k) / cover).reshape(len(p), -1)
    return out, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", out, out), 0))


def at_most(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(len(a), len(b)): what similarities of the pictures of two outlines do not exceed, but for rounding.

    A window's similarity is at most 1 and its correlation c, and at most 0 where c is negative, so at most (1 + c) / 2; the mean of c is the
    product of the outlines and of what they leave out, and the latter is at most the product of its lengths.
    """
    return (1 + a[0] @ b[0].T + np.outer(a[1], b[1])) / 2


def alike(a: np.ndarray, b: np.ndarray, least: float, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the pairs of `among` (len(a), len(b)) that are alike by `least` or more; pictures are 16-bit fractions, or in 0 to 1.

    The bound of their outlines, one product of matrices, rules most pairs out. Only pairs that are left are scored, and of the pictures at hand
    moments are taken once.
    """
    whole = lambda x: x / 65535.0 if x.dtype.kind == "u" else x
    drawn = lambda x: tuple(np.concatenate(c) for c in zip(*(outlines(whole(x[i : i + TILE])) for i in range(0, len(x), TILE)), strict=True))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if among.any():
        k, mine = _blur(a.shape[1]), drawn(a)
        at = among & (at_most(mine, mine if a is b else drawn(b)) >= least - SLACK)
        rows = np.flatnonzero(at.any(1))
        for r in (rows[i : i + TILE] for i in range(0, len(rows), TILE)):
            x = whole(a[r])
            mx, vx = _moments(x, k)
            cols = np.flatnonzero(at[r].any(0))
            for c in (cols[i : i + TILE] for i in range(0, len(cols), TILE)):
                y = whole(b[c])
                my, vy = _moments(y, k)
                for n in np.flatnonzero(at[np.ix_(r, c)].any(1)):
                    j = np.flatnonzero(at[r[n], c])
                    s = _scored(x[n : n + 1], mx[n : n + 1], vx[n : n + 1], y[j], my[j], vy[j], k)
                    found.append((np.full(len(j), r[n])[s >= least], c[j][s >= least], s[s >= least]))
    i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, i))
    return i[order], j[order], s[order]


def fine_pairs(items: DataFrame, least: float, id_col: str = "item_id", group_col: str = "group_id", thumb_col: str = "thumb") -> DataFrame:
    """(group_id, a, b, score double): pairs a < b of one coarse group whose pictures are alike by `least` or more.

    Equal pictures of a group are one class, compared once and named by their smallest id, and each other one is linked with that id
    at score 1; so links join all that is alike, but copies are not expanded into all pairs. Quadratic in the different pictures of a
    coarse group, by the metric's nature: give groups of fingerprints close to each other. Null groups, ids and thumbnails are in no pair; thumbnails of
    different sizes are not alike.
    """
    scratch = Scratch(items.sparkSession, "fine")
    x = items.select(F.col(group_col).alias("group_id"), F.col(id_col).alias("id"), F.col(thumb_col).alias("thumb")).where("group_id IS NOT NULL AND id IS NOT NULL AND thumb IS NOT NULL")
    x = scratch.save(x.withColumn("key", F.sha2("thumb", 256)))
    # classes by digest, so that the pictures of copies are not shuffled to be compared
    rep = scratch.save(x.groupBy("group_id", "key").agg(F.min("id").alias("rep")))
    copies = x.drop("thumb").join(rep, ["group_id", "key"]).where("id <> rep").select("group_id", F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score")).distinct()
    first = rep.select("group_id", F.col("rep").alias("id"))
    x = x.drop("key").join(first, ["group_id", "id"], "left_semi").dropDuplicates(["group_id", "id"])
    sizes = first.groupBy("group_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    x = x.join(sizes, "group_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    x = x.select("group_id", "id", "thumb", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    kind = {f.name: f.dataType.simpleString() for f in x.schema}

    def score(t: pa.Table) -> pa.Table:
        lo, hi, found = t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), []
        sizes, ids, own = pc.binary_length(t.column("thumb")).to_numpy(), t.column("id").to_numpy(), t.column("own").to_numpy()
        for size in np.unique(sizes):
            side = int((size // 2) ** 0.5)
            if side < 11 or side * side * 2 != size:
                continue
            i, j = np.flatnonzero((own == lo) & (sizes == size)), np.flatnonzero((own == hi) & (sizes == size))
            if not len(i) or not len(j):
                continue
            x, y = (np.frombuffer(b"".join(t.column("thumb").take(at).to_pylist()), "<u2").reshape(-1, side, side) for at in (i, j))
            among = ids[i][:, None] < ids[j][None, :] if lo == hi else np.ones((len(i), len(j)), bool)
            p, q, scores = alike(x, x if lo == hi else y, least, among)
            p, q = i[p], j[q]
            first = ids[p] < ids[q]
            group = t.column("group_id").take(np.zeros(len(p), np.int64))
            found.append(pa.table([group, *(t.column("id").take(at.astype(np.int64)) for at in (np.where(first, p, q), np.where(first, q, p))), scores], names))
        none = [t.column(c).slice(0, 0) for c in ("group_id", "id", "id")]
        return pa.concat_tables(found) if found else pa.table([*none, np.empty(0)], names)

    names = ["group_id", "a", "b", "score"]
    near = x.groupBy("group_id", "lo", "hi").applyInArrow(lambda t: score(t), f"group_id {kind['group_id']}, a {kind['id']}, b {kind['id']}, score double")
    return scratch.save(near.unionByName(copies))


def fine_clusters(items: DataFrame, pairs: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(item_id, cluster): items joined by links, named by the smallest; null for items that are like no other."""
    groups = grouping.groups_only(grouping.similarity_groups(items, pairs, id_col)).withColumnRenamed("group_id", "cluster")
    return items.select(F.col(id_col).alias("item_id")).join(groups, "item_id", "left")


def medoids(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster, medoid, mean_score): the item of each cluster with the largest sum of scores of its links, its first one at a tie; the mean is over its links."""
    ends = pairs.select("a", "score").union(pairs.select("b", "score")).toDF("item_id", "score")
    sums = ends.groupBy("item_id").agg(F.round(F.sum("score"), 9).alias("s"), F.count("*").alias("n"))
    best = clusters.where("cluster IS NOT NULL").join(sums, "item_id").groupBy("cluster").agg(F.min(F.struct((-F.col("s")).alias("s"), "item_id", "n")).alias("m"))
    return best.select("cluster", F.col("m.item_id").alias("medoid"), (-F.col("m.s") / F.col("m.n")).alias("mean_score"))
