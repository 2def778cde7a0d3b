"""Similarity joins on fingerprints and vectors, and statistics of pairs.

Distances are never computed for all pairs where a threshold is given: the pigeonhole principle turns the
threshold into equality of one of several bands, so candidates come from an equi-join. `all_pairs` is the one
operator that is quadratic by definition; it says so.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions import hashing, vectors
from siftmill.operators.needles import PART_CHARS, contained


def all_pairs(items: DataFrame, distance, id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, a_*, b_*, distance) of all pairs a < b: quadratic, for sets whose full distance table is the result.

    `distance` takes the prefixes "a_" and "b_" and returns a column.
    """
    side = lambda p: items.select(F.col(id_col).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in keep])
    return side("a").join(side("b"), F.col("a") < F.col("b")).withColumn("distance", distance("a_", "b_"))


def class_pairs(items: DataFrame, distance, key: str, id_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., distance, n): how many pairs of rows have each distance, over all pairs of rows.

    Rows of one `key` are a class that is compared once; a pair of classes counts for the product of their sizes, and a class
    for the pairs within it, at distance 0. Quadratic in classes, not in rows. `distance` is as in `all_pairs`, of the keys.
    """
    classes = items.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(id_col).alias("m"))
    a, b = (classes.select(*[F.col(c).alias(f"{p}_{c}") for c in (*by, key, "m")]) for p in "ab")
    on = F.col(f"a_{key}") < F.col(f"b_{key}")
    for c in by:
        on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    across = a.join(b, on).select(*[F.col(f"a_{c}").alias(c) for c in by], distance("a_", "b_").alias("distance"), (F.col("a_m") * F.col("b_m")).alias("n"))
    within = classes.where("m > 1").select(*by, F.lit(0).alias("distance"), F.expr("m * (m - 1) div 2").alias("n"))
    return across.unionByName(within).where("distance IS NOT NULL").groupBy(*by, "distance").agg(F.sum("n").alias("n"))


def band_plan(bits: int, threshold: int, min_width: int = 12) -> tuple[list[tuple[int, int]], int]:
    """([(start, width)...], flips): hashes within `threshold` agree on one of the bands up to `flips` bits.

    With threshold + 1 bands one band is equal; where that makes bands narrower than `min_width`, half as many bands
    and one differing bit are used, and so on: bands * (flips + 1) > threshold.
    """
    flips = 0
    while bits // (threshold // (flips + 1) + 1) < min_width and flips < 2:
        flips += 1
    n = min(threshold // (flips + 1) + 1, bits)
    edges = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], flips


def _bit_range(chunks: Column, start: int, width: int, chunk_bits: int) -> Column:
    """`width` bits from `start` of an array of chunks as a bigint; bits count from the low end of the first chunk."""
    out, got = F.lit(0).cast("bigint"), 0
    while got < width:
        i, at = divmod(start + got, chunk_bits)
        n = min(width - got, chunk_bits - at)
        piece = F.shiftrightunsigned(chunks[i], at).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))
        out = out.bitwiseOR(F.shiftleft(piece, got))
        got += n
    return out


def _masks(width: int, flips: int) -> list[int]:
    """What up to `flips` differing bits of a band of `width` bits change."""
    out = [0] + ([1 << x for x in range(width)] if flips else [])
    return out + ([1 << x | 1 << y for x in range(width) for y in range(x)] if flips > 1 else [])


def _keys(chunks: Column, bits: int, threshold: int, chunk_bits: int, probe: bool) -> Column:
    """(band, value) of each band and, to probe with, of its neighbours: the masks are constants that expressions loop over."""
    bands, flips = band_plan(bits, threshold)
    own = F.array(*[F.struct(F.lit(i).alias("band"), _bit_range(chunks, start, width, chunk_bits).alias("value")) for i, (start, width) in enumerate(bands)])
    if not probe or not flips:
        return own
    masks = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in _masks(width, flips)]) for _, width in bands])
    return F.flatten(F.transform(own, lambda b: F.transform(F.get(masks, b["band"]), lambda m: F.struct(b["band"].alias("band"), b["value"].bitwiseXOR(m).alias("value")))))


def bands_prune(bits: int, threshold: int, least: float = 4.0) -> bool:
    """Whether bands give less than 1 / `least` of the candidates that comparing everything once gives; a share that does not depend on the data."""
    bands, flips = band_plan(bits, threshold)
    return sum(len(_masks(width, flips)) / 2.0**width for _, width in bands) * least < 1


def _blocked(left: DataFrame, right: DataFrame, blocks: int) -> DataFrame:
    """Every row of `left` beside every row of `right`: both are dealt to `blocks` parts, and a pair of parts is a key of an equi-join."""
    n = F.lit(blocks).cast("long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    a = left.withColumn("_x", F.pmod(F.xxhash64("l"), n)).withColumn("_y", every)
    b = right.withColumn("_y", F.pmod(F.xxhash64("r"), n)).withColumn("_x", every)
    return a.hint("merge").join(b, ["_x", "_y"])


def hamming_join(
    left: DataFrame, right: DataFrame, threshold: int, bits: int, id_col: str = "id", chunks_col: str = "chunks", chunk_bits: int = 52
) -> DataFrame:
    """(l, r, distance) of all pairs within `threshold` bits; exact.

    Rows of `left` are keyed by their bands, rows of `right` by their bands and, where the plan allows
    differing bits, their neighbours; hot bands are split by AQE's skew join, and pairs that met in several bands are made one.
    A threshold so wide that bands would prune little (`bands_prune`) has everything compared once, block by block, which is then the
    cheaper way; like its result, that is quadratic. Null fingerprints match nothing. Neither side is broadcast: Spark takes a table for as small
    as its compressed files, and arrays of chunks are many times that.
    """
    a = left.where(F.col(chunks_col).isNotNull()).select(F.col(id_col).alias("l"), F.col(chunks_col).alias("lc"))
    b = right.where(F.col(chunks_col).isNotNull()).select(F.col(id_col).alias("r"), F.col(chunks_col).alias("rc"))
    pruned = bands_prune(bits, threshold)
    if pruned:
        keys = lambda c, probe: F.explode(_keys(F.col(c), bits, threshold, chunk_bits, probe))
        j = a.withColumn("k", keys("lc", False)).hint("merge").join(b.withColumn("k", keys("rc", True)), "k")
    else:
        j = _blocked(a, b, max(2, math.isqrt(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    j = j.withColumn("distance", hashing.chunk_distance(F.col("lc"), F.col("rc"))).where(F.col("distance") <= threshold).select("l", "r", "distance")
    return j.distinct()


def hamming_pairs(items: DataFrame, threshold: int, bits: int, id_col: str = "id", chunks_col: str = "chunks", chunk_bits: int = 52) -> DataFrame:
    """(a, b, distance) of pairs a < b within `threshold`.

    Items of one fingerprint are compared once, as a class, and then paired with each other and with the partners of
    their class: pairs are the result, so their number is the output's.
    """
    classes = items.groupBy(chunks_col).agg(F.min(id_col).alias(id_col))
    near = hamming_join(classes, classes, threshold, bits, id_col, chunks_col, chunk_bits).where("l < r")
    member = items.join(classes.select(chunks_col, F.col(id_col).alias("rep")), chunks_col).select(F.col(id_col).alias("id"), "rep")
    m1, m2 = member.select(F.col("id").alias("x"), F.col("rep").alias("l")), member.select(F.col("id").alias("y"), F.col("rep").alias("r"))
    across = near.join(m1, "l").join(m2, "r").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    same = m1.join(m2, F.col("l") == F.col("r")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("distance"))
    return across.unionByName(same)


def hamming_links(items: DataFrame, threshold: int, bits: int, id_col: str = "id", chunks_col: str = "chunks", chunk_bits: int = 52) -> DataFrame:
    """(a, b, distance) of the links within `threshold`, a < b, without expanding copies into all pairs.

    Items of one fingerprint are a class, represented by its smallest id. Each other item has one row with its representative, at distance 0;
    each pair of classes within `threshold` has one row of their representatives, at a distance above 0. Two items are within `threshold` if
    their representatives are, so no pair is lost, and rows grow with the items and with the pairs of different fingerprints.
    """
    x = items.where(F.col(chunks_col).isNotNull())
    classes = x.groupBy(chunks_col).agg(F.min(id_col).alias(id_col))
    near = hamming_join(classes, classes, threshold, bits, id_col, chunks_col, chunk_bits).where("l < r").toDF("a", "b", "distance")
    member = x.select(F.col(id_col).alias("b"), chunks_col).hint("merge").join(classes.select(chunks_col, F.col(id_col).alias("a")), chunks_col)
    return near.unionByName(member.where("a < b").select("a", "b", F.lit(0).alias("distance")))


def reference_match(items: DataFrame, reference: DataFrame, threshold: int, bits: int, id_col: str = "id", chunks_col: str = "chunks", uri_col: str = "uri", chunk_bits: int = 52) -> DataFrame:
    """(id, ref_uri, distance): the nearest reference within `threshold` of each item, the smallest URI at a tie.

    A reference with an item's own URI never matches it. Items without a match have no row. Items of one fingerprint are compared
    with the references once, as a class.
    """
    has = items.where(F.col(chunks_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.col(chunks_col).alias("c"))
    classes = has.select(F.col("c").alias("id"), F.col("c").alias(chunks_col)).distinct()
    near = hamming_join(classes, reference.select(F.col(uri_col).alias("id"), chunks_col), threshold, bits, "id", chunks_col, chunk_bits)
    near = near.groupBy(F.col("l").alias("c"), F.col("r").alias("ref_uri")).agg(F.min("distance").alias("distance"))
    # an item's own URI can take away one reference only, so that the nearest two of a class decide for all its items
    best = near.withColumn("_at", F.row_number().over(Window.partitionBy("c").orderBy("distance", "ref_uri"))).where("_at <= 2").drop("_at")
    met = has.hint("merge").join(best, "c").where(~F.col("uri").eqNullSafe(F.col("ref_uri")))
    return met.groupBy("id").agg(F.min(F.struct("distance", "ref_uri")).alias("m")).select("id", "m.ref_uri", "m.distance")


def vector_pairs(items: DataFrame, id_col: str = "id", vector_col: str = "embedding", block_col: str | None = None) -> DataFrame:
    """(a, b, score) of all pairs a < b of one block, by cosine; without blocks the full matrix, quadratic by definition.

    Lengths of vectors are taken once. The score is null where a vector is null, zero, or of another length than its partner.
    """
    v = items.withColumn("_norm", F.sqrt(vectors.dot(F.col(vector_col), F.col(vector_col))))
    side = lambda p: v.select(F.col(id_col).alias(p), F.col(vector_col).alias(f"{p}_v"), F.col("_norm").alias(f"{p}_n"), *([F.col(block_col).alias(f"{p}_k")] if block_col else []))
    on = F.col("a") < F.col("b")
    if block_col:
        on = (F.col("a_k") == F.col("b_k")) & on
    norm = F.col("a_n") * F.col("b_n")
    score = F.when((F.size("a_v") == F.size("b_v")) & (norm > 0), vectors.dot(F.col("a_v"), F.col("b_v")) / norm)
    return side("a").join(side("b"), on).select("a", "b", score.alias("score"))


#: Vectors that a task compares with as many others at a time.
VECTOR_BLOCK = 1024


def best_pairs(items: DataFrame, n: int, id_col: str = "id", vector_col: str = "embedding", block_col: str | None = None, digits: int = 6) -> DataFrame:
    """(a, b, score): the n pairs a < b, within one block, of largest cosine rounded to `digits`; ties by (a, b).

    A report: every pair is looked at, but none is put out that is not among the n best of its task. Blocks are cut into parts of about
    VECTOR_BLOCK rows, and each pair of parts is a group of its own, whatever a block's size. Null and zero vectors, and those
    with null or non-finite components, pair with nothing, as do vectors of different lengths and rows without a block.
    """
    x = items.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), (F.col(block_col) if block_col else F.lit(0)).alias("k")).where("v IS NOT NULL AND k IS NOT NULL")
    sizes = x.groupBy("k").agg(F.ceil(F.count("*") / VECTOR_BLOCK).alias("parts"))
    x = x.join(sizes, "k").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    x = x.select("id", "v", "k", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    kind = items.schema[id_col].dataType.simpleString()

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        for _, rows in pdf.groupby(pdf["v"].map(len)):
            m = np.array(rows["v"].tolist(), np.float64).reshape(len(rows), -1)
            size = np.sqrt((m * m).sum(1))
            good = np.isfinite(size) & (size > 0)
            m, ids, part = m[good] / size[good, None], rows["id"].to_numpy()[good], rows["part"].to_numpy()[good]
            i, j = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
            if not len(i) or not len(j):
                continue
            score = m[i] @ m[j].T
            near = np.floor(score * 10**digits + 0.5)
            pick = ids[i][:, None] < ids[j][None, :]
            if lo != hi:
                pick |= ids[i][:, None] > ids[j][None, :]
            p, q = np.nonzero(pick)
            if len(p) > n:
                least = np.partition(near[p, q], len(p) - n)[len(p) - n]
                keep = near[p, q] >= least
                p, q = p[keep], q[keep]
            a, b = np.minimum(ids[i][p], ids[j][q]), np.maximum(ids[i][p], ids[j][q])
            order = np.lexsort((b, a, -near[p, q]))[:n]
            found.append(pd.DataFrame({"a": a[order], "b": b[order], "score": score[p, q][order]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "score": []})

    few = x.groupBy("k", "lo", "hi").applyInPandas(best, f"a {kind}, b {kind}, score double")
    return top_pairs(few.withColumn("score", F.round("score", digits)), n)


#: Vectors of a part whose pairs are counted, not put out, and rows and columns of scores that are held at a time.
SCORE_BLOCK, SCORE_TILE = 4096, 1024


def block_scores(items: DataFrame, id_col: str, vector_col: str, block_col: str) -> DataFrame:
    """(block_col, n_pairs long, avg_score, max_score double): count, mean and largest cosine of all pairs a < b of each block.

    As many pairs as `vector_pairs` has, none of which is put out: a block is cut into parts of about SCORE_BLOCK rows, a pair of parts is a group of its own,
    and its scores are summed tile by tile. Pairs count without a score where a vector is null, zero, holds a null, or is of another length than its partner. Null ids
    and blocks are in no pair; blocks without pairs have no row.
    """
    v = F.col(vector_col).cast("array<double>")
    x = items.select(F.col(id_col).alias("id"), F.when(~F.exists(v, lambda c: c.isNull()), v).alias("v"), F.col(block_col).alias("k")).where("id IS NOT NULL AND k IS NOT NULL")
    sizes = x.groupBy("k").agg(F.ceil(F.count("*") / SCORE_BLOCK).alias("parts"))
    # a part goes to the pairs that it is in, so that rows of one id, which are no pair, are always in one part
    x = x.join(sizes, "k").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    x = x.select("id", "v", "k", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    kind = x.schema["k"].dataType.simpleString()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        ids, part = pdf["id"].to_numpy(), pdf["part"].to_numpy()
        length = pdf["v"].map(lambda q: -1 if q is None else len(q)).to_numpy()
        before = lambda p, q: ids[p][:, None] < ids[q][None, :]
        n_pairs, n, add, most = 0, 0, 0.0, -math.inf
        i, j = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        if lo != hi:
            n_pairs = len(i) * len(j)
        else:
            n_pairs = sum(int(before(i[a : a + SCORE_TILE], j).sum()) for a in range(0, len(i), SCORE_TILE))
        for size in np.unique(length[length > 0]):
            p, q = i[length[i] == size], j[length[j] == size]
            m, w = (np.array(pdf["v"].iloc[at].tolist(), np.float64).reshape(len(at), size) for at in (p, q))
            with np.errstate(all="ignore"):
                nm, nw = np.sqrt((m * m).sum(1)), np.sqrt((w * w).sum(1))
                for a in range(0, len(p), SCORE_TILE):
                    for b in range(0, len(q), SCORE_TILE):
                        rows, cols = slice(a, a + SCORE_TILE), slice(b, b + SCORE_TILE)
                        norm = nm[rows, None] * nw[None, cols]
                        has = ~(norm <= 0)
                        if lo == hi:
                            has &= before(p[rows], q[cols])
                        score = (m[rows] @ w[cols].T / norm)[has]
                        if len(score):
                            n, add, most = n + len(score), add + float(score.sum()), float(np.maximum(most, score.max()))
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n_pairs": [n_pairs], "n": [n], "s": [add], "m": pd.Series([most if n else None], dtype=object)})

    got = x.groupBy("k", "lo", "hi").applyInPandas(total, f"k {kind}, n_pairs long, n long, s double, m double")
    found = got.groupBy(F.col("k").alias(block_col)).agg(F.sum("n_pairs").alias("n_pairs"), F.try_divide(F.sum("s"), F.sum("n")).alias("avg_score"), F.max("m").alias("max_score"))
    return found.where("n_pairs > 0")


def top_pairs(pairs: DataFrame, n: int, score_col: str = "score", largest: bool = True) -> DataFrame:
    """The n best pairs; ties by (a, b)."""
    return pairs.orderBy(F.desc(score_col) if largest else F.asc(score_col), "a", "b").limit(n)


def first_pairs(items: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """(a, b): the first n pairs a < b in the order of (a, b). The first n + 1 items hold them all; null ids are in no pair."""
    few = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("a")).distinct().orderBy("a").limit(n + 1)
    return few.join(few.select(F.col("a").alias("b")), F.col("a") < F.col("b")).orderBy("a", "b").limit(n)


def distance_stats(pairs: DataFrame, by: tuple[str, ...] = (), distance_col: str = "distance") -> DataFrame:
    """Count, mean, least, largest, median and population deviation of distances, per group; null distances do not count."""
    d = F.col(distance_col)
    return pairs.where(d.isNotNull()).groupBy(*by).agg(
        F.count(d).alias("n_pairs"), F.avg(d).alias("avg_distance"), F.min(d).alias("min_distance"), F.max(d).alias("max_distance"),
        F.median(d).alias("median_distance"), F.stddev_pop(d).alias("std_distance"),
    )


def counted_stats(counts: DataFrame, by: tuple[str, ...] = (), distance_col: str = "distance", n_col: str = "n") -> DataFrame:
    """As `distance_stats`, of rows (distance, n) that stand for n pairs each."""
    d, n = F.col(distance_col), F.col(n_col)
    mean = F.sum(d * n) / F.sum(n)
    return counts.groupBy(*by).agg(
        F.sum(n).alias("n_pairs"), mean.alias("avg_distance"), F.min(d).alias("min_distance"), F.max(d).alias("max_distance"),
        F.expr(f"percentile({distance_col}, 0.5, {n_col})").alias("median_distance"),
        F.sqrt(F.greatest(F.sum(d * d * n) / F.sum(n) - mean * mean, F.lit(0.0))).alias("std_distance"),
    )


def match_rates(pairs: DataFrame, thresholds: tuple[int, ...] = (2, 5, 8, 10, 12, 15, 20), by: tuple[str, ...] = (), distance_col: str = "distance") -> DataFrame:
    """(by..., threshold, matches, rate): one aggregation for all thresholds, then unpivoted."""
    d = F.col(distance_col)
    one = pairs.where(d.isNotNull()).groupBy(*by).agg(F.count(d).alias("n"), *[F.count_if(d <= t).alias(f"t{t}") for t in thresholds])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("matches")) for t in thresholds])).alias("r")
    return one.select(*by, "n", rows).select(*by, "r.threshold", "r.matches", (F.col("r.matches") / F.col("n")).alias("rate"))


def histogram(pairs: DataFrame, low: float, high: float, bins: int = 30, value_col: str = "distance") -> DataFrame:
    """(bin, n) of values in [low, high], the top edge in the last bin; empty bins have no row."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value_col) - low) / width), F.lit(bins - 1)).cast("int")
    return pairs.where(F.col(value_col).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def label_counts(labels: DataFrame, label_col: str = "label", noise: int = -1) -> DataFrame:
    """(n_clusters, n_noise, n_items) of a clustering."""
    x = F.col(label_col)
    return labels.agg(F.count_distinct(F.when(x != noise, x)).alias("n_clusters"), F.count_if(x == noise).alias("n_noise"), F.count("*").alias("n_items"))


#: Parts of needles up to which texts are read once per part; beyond, long needles meet texts by word n-grams.
MOST_PARTS = 8


def containment(items: DataFrame, needles: DataFrame, text_col: str, needle_col: str, words: int = 5) -> DataFrame:
    """Rows of `items` joined with the `needles` that their text contains.

    Texts go through automata over the needles (`needles.contained`). Where these are too many for a few automata, a needle of at
    least `words` + 2 words is found by `words` whole words in a row, which texts that hold it have too: an equi-join on word n-grams, of the
    needle's side only one, and automata are left with the shorter ones. Null and empty needles are in no text.
    """
    n = needles.withColumn("_size", F.length(needle_col)).where("_size > 0")
    every = int(n.agg(F.sum("_size")).first()[0] or 0)
    by_automaton = lambda few: contained(items, few, text_col, needle_col).join(few.drop("_size", "_w"), needle_col)
    order = [*items.columns, *needles.columns]
    if every <= MOST_PARTS * PART_CHARS:
        return by_automaton(n).select(*order)
    gram = lambda w, i: F.array_join(F.slice(w, i, words), " ")
    split = lambda c: F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    n = n.withColumn("_w", split(F.col(needle_col)))
    # the first and last word of a needle may be cut words of the text, so that the key starts at its second
    long = n.where(F.size("_w") >= words + 2).withColumn("_key", gram(F.col("_w"), F.lit(2))).drop("_w", "_size")
    t = items.withColumn("_t", split(F.col(text_col)))
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_t") - (words - 1), F.lit(1))), lambda i: gram(F.col("_t"), i)))
    t = t.withColumn("_key", F.explode(keys)).drop("_t")
    return t.join(long, "_key").where(F.col(text_col).contains(F.col(needle_col))).select(*order).unionByName(by_automaton(n.where(F.size("_w") < words + 2)).select(*order))
