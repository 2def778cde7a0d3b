"""Near-duplicate embeddings by random-hyperplane sign hashing, exact verification and connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt
from siftmill.operators.components import connected_components
from siftmill.plans.scratch import Scratch

#: Vectors of a bucket are compared in square blocks of this many; a task holds two blocks at a time.
BLOCK = 1024
#: Further signs, by which a bucket's vectors are sifted before the vectors themselves are brought together.
SKETCH = 256


def table_plan(n: int, cosine: float, miss: float = 1e-4, per_bucket: int = 64) -> tuple[int, int]:
    """(bits, tables): bits so that evenly spread vectors fall about `per_bucket` to a bucket, and as many tables as keep
    the chance to miss a pair at exactly `cosine` in all of them below `miss`."""
    bits = max(4, min(24, math.ceil(math.log2(max(n, 2) / per_bucket)))) if n > per_bucket else 4
    same = (1 - math.acos(min(cosine, 1.0)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same))) if same < 1 else 1


def sketch_limit(cosine: float, miss: float) -> int:
    """In how many of SKETCH signs a pair at exactly `cosine` differs at most, but for a chance of `miss`."""
    p = math.acos(min(cosine, 1.0)) / math.pi
    tail, k = 1.0, -1
    while tail > miss and k < SKETCH:
        k += 1
        tail -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
    return k


def _valid(v: list | None) -> bool:
    return bool(v) and None not in v


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    seed: int = 11,
    miss: float = 1e-4,
) -> DataFrame:
    """(id, n_links long, component_id, kept boolean): one row per input row id.

    Two vectors link when their labels are equal and not null and their cosine, in double precision, is at
    least `cosine`. Vectors that are null, empty, zero, or hold null or non-finite components, and those
    without label (if `label_col` is given) or of different length, link with nothing. Candidates share the signs of `bits` random
    projections in one of several tables (`table_plan`; both numbers follow the row count) and nearly all of SKETCH further signs
    (`sketch_limit`); every pair that is left is verified exactly, so no link is below the threshold. Only ids and signs are dealt out by
    table; vectors follow where they have a candidate.

    Equal vectors are one class and are compared once. A bucket is never held by one task: it is cut into
    blocks of about BLOCK vectors by a hash, and each pair of blocks is a group of its own; tasks put out
    counts and spanning links, never pairs. A pair that shares several tables counts in the first of them.
    component_id is the smallest id reachable by links, kept says whether it is the row's own.

    Rows that repeat an id are vectors of their own and link like any others, but share the id's component.
    An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    bt.small_batches(spark)
    scratch = Scratch(spark, "near-embed")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), label.alias("label"))
    kind = src.schema["id"].dataType.simpleString()
    raw_type = np.float32 if single else np.float64  # as exact as the input is

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, raws = [], []
            for v in b.column("v").to_pylist():
                x = np.array(v, np.float64) if _valid(v) else np.zeros(0)
                top = np.abs(x).max() if len(x) else 0.0
                usable_ = np.isfinite(top) and top > 0
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if usable_ else None)
                raws.append(x.astype(raw_type).tobytes() if usable_ else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["id", "label", "key", "raw"])

    rows = src.mapInArrow(bt.tidied(prepare), f"id {kind}, label string, key binary, raw binary")
    rows = scratch.save(rows)
    usable = rows.where("key is not null and label is not null")
    # classes of equal vectors: the smallest id stands for all
    classes = scratch.save(usable.groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")))
    # two classes may hold rows of one id: `cid` tells them apart
    classes = classes.withColumn("cid", F.xxhash64("label", "key"))
    largest = classes.groupBy("label").count().agg(F.max("count").alias("m")).first().m or 0
    bits, tables = table_plan(int(largest), cosine, miss)
    apart = sketch_limit(cosine, miss / 100)
    width = -(-bits // 8)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            raws = b.column("raw").to_pylist()
            size = np.array([len(u) // raw_type().itemsize for u in raws])
            buckets = np.empty((len(raws), tables), np.int64)
            sigs, sketch = np.empty((len(raws), tables * width), np.uint8), np.empty((len(raws), SKETCH // 8), np.uint8)
            for d in np.unique(size):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).normal(size=(int(d), tables * bits + SKETCH))
                at = np.flatnonzero(size == d)
                up = _units([raws[i] for i in at], raw_type) @ planes[d] >= 0
                s = up[:, : tables * bits].reshape(len(at), tables, bits)
                buckets[at] = s @ (1 << np.arange(bits)) * 65536 + d % 65536
                sigs[at] = np.packbits(s, axis=2).reshape(len(at), -1)
                sketch[at] = np.packbits(up[:, tables * bits :], axis=1)
            more = [pa.array(list(buckets), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sigs], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("label", "cid", "rep", "copies", "raw")] + more, ["label", "cid", "rep", "copies", "raw", "buckets", "sigs", "sketch"])

    signed = classes.mapInArrow(bt.tidied(sign), f"label string, cid long, rep {kind}, copies long, raw binary, buckets array<bigint>, sigs binary, sketch binary")
    signed = scratch.save(signed)
    spots = signed.select("cid", "label", "sketch", F.posexplode("buckets").alias("t", "bucket"))
    # buckets of more than a block are cut into blocks
    sizes = spots.groupBy("label", "t", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    spots = spots.join(scratch.save(sizes, slim=True), ["label", "t", "bucket"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1).cast("long")))
    spots = spots.withColumn("part", F.pmod(F.xxhash64("cid", F.lit(seed)), F.col("parts")))
    # block pairs (lo, hi): a row joins one group per block of its bucket
    spots = spots.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    group = ["label", "t", "bucket", "lo", "hi"]
    spots = spots.select("cid", "sketch", "label", "t", "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part")

    def dealt(x: DataFrame) -> DataFrame:
        return x.withColumn("g", F.xxhash64(*group)).repartition("g").sortWithinPartitions("g", *group, "cid").drop("g")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a group that have a partner whose sketch is near enough: most vectors have none, and go no further."""
        names = [*group, "part", "cid"]
        for key, rows_ in adjacent_groups(batches, group):
            part = rows_.column("part").to_numpy(zero_copy_only=False)
            left, right = np.flatnonzero(part == key[3]), np.flatnonzero(part == key[4])
            if len(rows_) < 2 or not len(left) or not len(right):
                continue
            sketch = np.frombuffer(b"".join(rows_.column("sketch").to_pylist()), np.uint64).reshape(len(part), -1)
            hit = np.zeros(len(part), bool)
            for at in range(0, len(left), 128):
                few = left[at : at + 128]
                near = np.bitwise_count(sketch[few][:, None, :] ^ sketch[right][None, :, :]).sum(2, dtype=np.int64) <= apart
                near &= few[:, None] != right[None, :]
                hit[few] |= near.any(1)
                hit[right] |= near.any(0)
            if hit.any():
                yield rows_.select(names).filter(pa.array(hit))

    kinds = "label string, t int, bucket long, lo long, hi long, part long, cid long"
    near = scratch.save(dealt(spots).mapInArrow(bt.tidied(sift), kinds))
    work = near.join(signed.select("cid", "rep", "copies", "raw", "sigs"), "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows_ in adjacent_groups(batches, group):
            t, lo, hi = key[1], key[3], key[4]
            unit = _units(rows_.column("raw").to_pylist(), raw_type)
            sigs = np.frombuffer(b"".join(rows_.column("sigs").to_pylist()), np.uint8).reshape(len(rows_), tables, width)
            part = rows_.column("part").to_numpy(zero_copy_only=False)
            copies = rows_.column("copies").to_numpy(zero_copy_only=False)
            left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
            if not len(left) or not len(right):
                continue
            linked = unit[left] @ unit[right].T >= cosine
            for e in range(t):  # counted in an earlier table
                linked &= (sigs[left, e][:, None] != sigs[right, e][None, :]).any(2)
            if lo == hi:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            n = np.zeros(len(part), np.int64)
            n[left] += linked @ copies[right]
            if lo != hi:
                n[right] += copies[left] @ linked
            # spanning links: the first linked partner of either side, then the roots that these leave apart
            root = _spanning(linked, left, right, len(part))
            hit = np.flatnonzero((n > 0) | (root != np.arange(len(part))))
            yield pa.RecordBatch.from_arrays(
                [rows_.column("cid").take(pa.array(hit)), pa.array(n[hit]), rows_.column("rep").take(pa.array(hit)), rows_.column("rep").take(pa.array(root[hit]))], ["cid", "n", "rep", "to"]
            )

    found = scratch.save(dealt(work).mapInArrow(bt.tidied(compare), f"cid long, n long, rep {kind}, to {kind}"))
    # written, as the classes are, so that AQE can split a class of very many copies in the joins
    counts = scratch.save(found.groupBy("cid").agg(F.sum("n").alias("n")), slim=True)
    own = scratch.save(usable.groupBy("id", "label", "key").agg(F.count("*").alias("own")), slim=True)
    known = scratch.save(classes.select("label", "key", "cid", "rep", "copies").join(counts, "cid", "left").select("label", "key", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies")).alias("n")), slim=True)
    # copies of one vector are linked with each other
    members = own.join(known, ["label", "key"])
    edges = found.select(F.col("rep").alias("a"), F.col("to").alias("b")).union(members.select("id", "rep"))
    comp = connected_components(edges).withColumnRenamed("node", "id")
    per = members.groupBy("id").agg(F.sum(F.col("n") - F.col("own")).alias("n_links")).join(comp, "id", "left")
    out = rows.select("id").join(per, "id", "left")
    cid = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.col("id").eqNullSafe(cid).alias("kept"))


def _units(raws: list[bytes], kind) -> np.ndarray:
    """Unit vectors, in double precision; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Root of each row in the graph of `linked`, by breadth-first sweeps over the matrix."""
    root = np.arange(n)
    open_l = np.ones(len(left), bool)
    pos_r = {int(x): i for i, x in enumerate(right)}
    pos_l = {int(x): i for i, x in enumerate(left)}
    for i in range(len(left)):
        if not open_l[i]:
            continue
        open_l[i] = False
        if not linked[i].any():
            continue
        seen = {int(left[i])}
        front = [int(left[i])]
        while front:
            step: set[int] = set()
            ls = [pos_l[x] for x in front if x in pos_l]
            rs = [pos_r[x] for x in front if x in pos_r]
            if ls:
                open_l[ls] = False
                step.update(right[linked[ls].any(0)].tolist())
            if rs:
                step.update(left[linked[:, rs].any(1)].tolist())
            front = list(step - seen)
            seen |= step
        root[list(seen)] = min(seen)
    return root


def adjacent_groups(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of each group, from batches in which equal groups are adjacent; keeps one group and one batch at a time."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        ends = np.zeros(b.num_rows, bool)
        ends[0] = True
        for c in group:
            col = b.column(c)
            ends[1:] |= np.asarray(pc.not_equal(col[1:], col[:-1]))
        starts = np.flatnonzero(ends)
        for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
            key = tuple(b.column(c)[int(s)].as_py() for c in group)
            if key != last and held:
                yield last, _one_batch(held)
                held = []
            last = key
            held.append(table.slice(int(s), int(e - s)))
    if held:
        yield last, _one_batch(held)


def _one_batch(parts: list[pa.Table]) -> pa.RecordBatch:
    return pa.concat_tables(parts).combine_chunks().to_batches()[0]
