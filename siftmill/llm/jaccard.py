"""Size-aware n-gram Jaccard join, exact at its threshold.

Texts become sets of word shingles; equal sets are one class. Candidates share keys: small sets are found by the
fixed-size subsets (pairs) of their rarest shingles, large ones by scanning inverted lists of their rarest
shingles, and the boundary between them is where the estimated costs balance. Both are prefix filters over one total order of shingles
(frequent ones last), so no pair above the threshold is missed, whatever the order. Candidates that a parity bitmap
cannot rule out are verified on whole texts.
"""

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
from siftmill.llm.near_embed import adjacent_groups
from siftmill.operators.components import connected_components
from siftmill.plans.scratch import Scratch

PERCENT = 80
WORDS = 5
#: Shingles whose frequency is tracked while a task reads this many; what is frequent anywhere is so in some chunk.
CHUNK_SHINGLES = 1_000_000
#: Frequent shingles that are ordered last: a broadcast of at most this many numbers. Which shingles they are changes
#: the work to be done, never the result.
MAX_FREQUENT = 200_000
#: Lists of up to so many members are paired by a join; longer ones are scanned block by block against bitmaps.
SHORT_LIST = 8
#: Postings that a task deals out to buckets together, with those of one text more at most; keys that occur HOT times among them go there
#: once, with their count. A worker takes about 160 bytes a posting while it deals them out.
CHUNK_POSTINGS, HOT = 1 << 18, 16
#: Buckets of keys for each shuffle partition; a task holds one bucket at a time.
BUCKETS = 4
#: Postings of a bucket, which a task holds at a time: of more than BUCKETS * partitions * this, there are more buckets.
BUCKET_POSTINGS = 1 << 17
#: Lists of up to so many members are sifted by the sizes of sets that may link.
SIFTED = 16
#: Members of a long list in one block.
BLOCK = 512
#: One in so many shingles is counted to estimate the length of inverted lists, for the cost of the boundary only.
COST_SAMPLE = 16_384


def shingles(data: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z lowered; of all words where there are fewer."""
    buf = bt.LOWER[bt.as_array(data)]
    s, e = bt.word_spans(buf)
    if not len(s):
        return np.empty(0, np.uint64)
    h = bt.span_hashes(buf, s, e)
    return np.unique(bt.combine(h, k)) if len(h) >= k else bt.combine(h, len(h))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity bitmap of a set: bit (token mod width) is flipped per token; width is a power of two, one or two bits per token.

    A pair that differs in more than about a third of its tokens is ruled out by such a bitmap already.
    """
    width = max(64, 1 << math.ceil(math.log2(max(len(tokens), 1))))
    bits = np.bincount((tokens & bt.U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of the sets behind two bitmaps."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    if n < m:
        x, y, n, m = y, x, m, n
    while n > m:  # a wider bitmap folds onto a narrower one
        n //= 2
        x = (x & ((1 << n) - 1)) ^ (x >> n)
    return (x ^ y).bit_count()


def may_link(n: int, m: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference that sets of n and m shingles may have when linked."""
    need = -(-percent * (n + m) // (100 + percent))
    return n + m - 2 * need


def prefix_length(n: int, share: int, percent: int = PERCENT) -> int:
    """Rarest shingles of a set of n, of which it shares `share` at least with any set it links to."""
    return min(n, n - -(-percent * n // 100) + share)


def choose_boundary(sizes: dict[int, int], rounds: float, percent: int = PERCENT) -> int:
    """Largest size of a small set: where enumerating subsets of small sets and scanning lists for the rest cost least.

    `sizes`: set size -> sets. A subset costs one row; a scanned posting costs one row, and one for each of the
    `rounds` in which its list is compared on average: about log2 of the list's length, as each round joins components.
    """
    order = sorted(sizes)
    best, at = math.inf, 0
    for b in [0, *order]:
        cost = 0.0
        for n in order:
            p = prefix_length(n, 1, percent)
            if n <= b:
                q = prefix_length(n, 2, percent)
                cost += sizes[n] * q * (q - 1) / 2
            if n > b * percent // 100:
                cost += sizes[n] * p * (1 + rounds)
        if cost < best:
            best, at = cost, b
    return at


def postings(sizes: dict[int, int], boundary: int, percent: int = PERCENT) -> int:
    """How many postings the sets (size -> sets) put out: pairs of small ones, prefixes of those that may meet a large one."""
    total = 0
    for n, sets in sizes.items():
        q = prefix_length(n, 2, percent)
        total += sets * ((q * (q - 1) // 2 if n <= boundary else 0) + (prefix_length(n, 1, percent) if n > boundary * percent // 100 else 0))
    return total


def placed_keys(tokens: np.ndarray, boundary: int, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(join keys of a set, tokens of the order that stand before the last one of each key and are not in it).

    `frequent` (sorted) and `rank` give the shingles that come last, and their order.
    """
    n = len(tokens)
    late = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = np.where(frequent[at] == tokens, rank[at], 0)
    order = tokens[np.lexsort((tokens, late))]
    keys, before = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    if n > boundary or n >= boundary * percent // 100:
        keys.append(bt.mix(order[: prefix_length(n, 1, percent)] ^ bt.U(0x51)))
        before.append(np.arange(len(keys[-1])))
    if n <= boundary:
        q = order[: prefix_length(n, 2, percent)]
        i, j = np.triu_indices(len(q), 1)
        with np.errstate(over="ignore"):
            keys.append(bt.mix(q[i] * bt.U(0xC2B2AE3D27D4EB4F) ^ bt.mix(q[j])))
        before.append(j - 1)
    return np.concatenate(keys), np.concatenate(before)


def keys_of(tokens: np.ndarray, boundary: int, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return placed_keys(tokens, boundary, frequent, rank, percent)[0]


def largest_partner(n: int, before: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How large a set may be that links to one of `n` shingles, if theirs meet first at a key with `before` shingles before it.

    Of those none is shared, so at most n - before are. A linked pair passes, on both sides, at the first key where it meets.
    """
    return (100 + percent) * (n - before) // percent - n


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass one: kind 0 (id, n, key, bits) of every text; kind 1 (n = count, token) frequent in a chunk; kind 2 (token) sampled."""
    names = ["kind", "id", "n", "key", "bits", "token"]
    held: list[np.ndarray] = []
    texts_held = size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, texts_held, size
        value, count = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
        top = np.flatnonzero(count >= max(4, texts_held // 2000))
        top = top[np.argsort(-count[top], kind="stable")][:MAX_FREQUENT]
        few = np.flatnonzero(value % bt.U(COST_SAMPLE) == 0)
        few = np.repeat(few, count[few])
        token = np.concatenate([value[top], value[few]]).view(np.int64)
        n = np.concatenate([count[top], np.ones(len(few), np.int64)])
        kind = np.concatenate([np.ones(len(top), np.int8), np.full(len(few), 2, np.int8)])
        held, texts_held, size = [], 0, 0
        none = lambda t: pa.nulls(len(token), t)
        return pa.RecordBatch.from_arrays([pa.array(kind), none(id_type), pa.array(n), none(pa.binary()), none(pa.binary()), pa.array(token)], names)

    id_type = pa.int64()
    for b in batches:
        id_type = b.column("id").type
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            n, key, bits = [], [], []
            for t in bt.texts(part.column("text")):
                s = shingles(t or b"")
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
                held.append(s)
                texts_held += 1
                size += len(s)
                if size >= CHUNK_SHINGLES:
                    yield flush()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n), np.int8)), part.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int64())], names
            )
    yield flush()


def _blocks(broad, boundary: int, percent: int, buckets: int):
    """Postings of texts (id, z), in rows of one bucket of keys each: kind 0 of (keys, ids, ns, caps, cs); caps are of `largest_partner`.

    A key that a chunk of postings holds HOT times or more goes to its bucket once, with the smallest of its ids and the count;
    its postings go to any bucket, as kind 1: so a bucket gets few rows of any key, however many texts share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, (late, order) = zstandard.ZstdDecompressor(), broad.value
        held: list[np.ndarray] = []
        held_caps: list[np.ndarray] = []
        sizes: list[int] = []
        whose: list[pa.Array] = []
        size, turn = 0, 0

        def rows(kind: int, j: np.ndarray, k: np.ndarray, doc: np.ndarray, cap: np.ndarray, c: np.ndarray, ids: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            by = np.argsort(j, kind="stable")
            first = np.flatnonzero(np.diff(j[by], prepend=-1))
            ends = pa.array(np.concatenate((first, [len(by)])), pa.int32())
            lists = [pa.array(k[by].view(np.int64)), ids.take(pa.array(doc[by])), *(pa.array(x[by].astype(np.int32)) for x in (n[doc], cap, c))]
            return pa.RecordBatch.from_arrays(
                [pa.array(j[by][first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int8)), *(pa.ListArray.from_arrays(ends, x) for x in lists)], ["j", "kind", "keys", "ids", "ns", "caps", "cs"]
            )

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, turn
            ids, n = pa.concat_arrays(whose), np.array(sizes)
            k, cap, doc = np.concatenate(held), np.concatenate(held_caps), np.repeat(np.arange(len(held)), [len(x) for x in held])
            _, at, count = np.unique(k, return_inverse=True, return_counts=True)
            count = count[at]
            cold, often = np.flatnonzero(count < HOT), np.flatnonzero(count >= HOT)
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            often = often[np.lexsort((rank[doc[often]], k[often]))]
            lead = often[np.flatnonzero(np.concatenate(([True], k[often][1:] != k[often][:-1])))] if len(often) else often
            both = np.concatenate((cold, lead))
            if len(both):
                yield rows(0, (k[both] % bt.U(buckets)).astype(np.int64), k[both], doc[both], cap[both], np.concatenate((np.ones(len(cold), np.int64), count[lead])), ids, n)
            if len(often):
                turn += 1
                spread = (np.arange(len(often)) // 1000 * 7919 + turn * 104729 + int(k[often[0]] % bt.U(1 << 31))) % buckets
                yield rows(1, spread, k[often], doc[often], cap[often], np.ones(len(often), np.int64), ids, n)
            held.clear()
            held_caps.clear()
            sizes.clear()
            whose.clear()
            size = 0

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                done = 0
                for i, t in enumerate(part.column("z")):
                    s = shingles(z.decompress(t.as_py()))
                    sizes.append(len(s))
                    k, before = placed_keys(s, boundary, late, order, percent)
                    held.append(k)
                    held_caps.append(largest_partner(len(s), before, percent))
                    size += len(held[-1])
                    if size >= CHUNK_POSTINGS:
                        whose.append(part.column("id")[done : i + 1])
                        done = i + 1
                        yield from flush()
                whose.append(part.column("id")[done:])
        if held:
            yield from flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists of two or more texts, from blocks of a bucket: kind 0 of (k, id, n, cap, leader, nl, capl, m) is a posting with its
    list's length and its member of smallest id, kind 1 of (k, id, n, cap) one of a hot key, kind 2 of (k, leader, nl, capl, m) the list of a hot key.
    Members of a list of up to SIFTED that cannot link to any other by their caps are left out."""
    names = ["kind", "k", "id", "n", "cap", "leader", "nl", "capl", "m"]
    for (_, kind), rows in adjacent_groups(batches, ["j", "kind"]):
        k, ids, n, cap, c = (pc.list_flatten(rows.column(x)) for x in ("keys", "ids", "ns", "caps", "cs"))
        if kind == 1:
            for at in range(0, len(k), 10_000):
                own = [x[at : at + 10_000] for x in (k, ids, n, cap)]
                none = [pa.nulls(len(own[0]), t) for t in (ids.type, pa.int32(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(own[0]), np.int8)), *own, *none], names)
            continue
        key, size, most, count = (x.to_numpy() for x in (k, n, cap, c))
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        by = np.lexsort((rank, key))
        by = by[sifted(key[by], size[by], most[by], count[by])]
        if not len(by):
            continue
        first = np.flatnonzero(np.concatenate(([True], key[by][1:] != key[by][:-1])))
        m = np.add.reduceat(count[by], first)
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
        hot = np.maximum.reduceat(count[by], first) > 1
        keep = np.flatnonzero((m[own] > 1) & (count[by] == 1))
        for kinds, at, group in ((0, by[keep], own[keep]), (2, by[first[hot]], np.flatnonzero(hot))):
            head = by[first[group]]
            for i in range(0, len(at), 10_000):
                x, h = pa.array(at[i : i + 10_000]), pa.array(head[i : i + 10_000])
                lead = [y.take(h) for y in (ids, n, cap)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kinds, np.int8)), *(y.take(x) for y in (k, ids, n, cap)), *lead, pa.array(m[group[i : i + 10_000]])], names)


def sifted(key: np.ndarray, n: np.ndarray, cap: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which postings, sorted by key, have a partner in their list, as far as sizes and caps can tell; hot and long lists are kept whole."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.append(first, len(key)))
    stays = np.ones(len(key), bool)
    hot = np.maximum.reduceat(count, first) > 1
    stays[first[(length == 1) & ~hot]] = False
    for size in np.unique(length[(length > 1) & (length <= SIFTED) & ~hot]):
        lists = first[(length == size) & ~hot]
        for at in range(0, len(lists), 50_000):
            i = lists[at : at + 50_000, None] + np.arange(size)
            fits = (n[i][:, :, None] <= cap[i][:, None, :]) & (n[i][:, None, :] <= cap[i][:, :, None])
            fits &= ~np.eye(size, dtype=bool)
            stays[i] = fits.any(2)
    return np.flatnonzero(stays)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles long, component_id): one row per input row.

    Two ids link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest id reachable by links. Words are [^\\x20\\x09-\\x0D]+, A-Z lowered; a text with fewer words than
    a shingle is one shingle; null, empty and wordless texts have none and link with nothing.

    Classes of equal sets are found first and compared once. In each inverted list, first every member is
    compared with one leader; what this leaves in one component needs no more comparing. Of lists that still hold
    several components, all pairs across components are tested: short lists are joined with themselves, long ones are cut
    into blocks, and each pair of blocks is scanned in a task of its own that puts out only the pairs that a bitmap cannot
    rule out. Postings are shuffled once, in buckets of keys; of a key that very many texts share only counts go to its bucket, and its postings
    meet them in a join that AQE can split. So no list is ever held by one task.

    Rows that repeat an id share its component; null ids link with nothing and keep a null component. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    bt.small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    seen = scratch.save(src.mapInArrow(bt.tidied(_survey), f"kind tinyint, id {kind}, n long, key binary, bits binary, token long"))
    meta = seen.where("kind = 0").select("id", "n", "key", "bits")

    # frequent shingles last, the most frequent at the very end; a bounded list
    top = seen.where("kind = 1").groupBy("token").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "token").limit(MAX_FREQUENT).collect()
    frequent = np.array([r.token for r in top], np.int64).view(np.uint64)
    rank = np.arange(len(top), 0, -1)
    by = np.argsort(frequent)
    broad = spark.sparkContext.broadcast((frequent[by], rank[by]))
    # the boundary: sizes on a logarithmic scale (a few hundred numbers) and the mean number of rounds a posting takes part in
    step = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2("n") * 16) / 16)))
    classes = scratch.save(meta.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n")), slim=True)
    sizes = {int(r.size): r["count"] for r in classes.groupBy(step.alias("size")).count().collect()}
    rare = seen.where("kind = 2").groupBy("token").agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * F.log2("m")).alias("a"), F.sum("m").alias("b")).first()
    boundary = choose_boundary(sizes, (rare.a or 0) / max(rare.b or 1, 1), percent)

    # texts are shuffled this once, compressed; whatever needs them below reads them where they lie
    packed = scratch.save_by(_packed(src.where("id IS NOT NULL"), kind), "id")
    scratch.release()
    reps = scratch.save(classes.select(F.col("rep").alias("id")), slim=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts * BUCKETS, -(-postings(sizes, boundary, percent) // BUCKET_POSTINGS))
    blocks = packed.join(reps, "id", "left_semi").mapInArrow(
        bt.tidied(_blocks(broad, boundary, percent, buckets)), f"j int, kind tinyint, keys array<bigint>, ids array<{kind}>, ns array<int>, caps array<int>, cs array<int>"
    )
    met = blocks.repartition(max(parts, -(-buckets // (8 * BUCKETS))), "j").sortWithinPartitions("j", "kind").mapInArrow(bt.tidied(_meet), f"kind tinyint, k long, id {kind}, n int, cap int, leader {kind}, nl int, capl int, m long")
    met = scratch.save(met)
    # postings of hot keys have met nobody yet: both sides are written, so that AQE can split a hot key in this join
    hot = scratch.save(met.where("kind = 1").select("k", "id", "n", "cap").join(met.where("kind = 2").select("k", "leader", "nl", "capl", "m"), "k"), slim=True)
    lists = met.where("kind = 0").select("k", "id", "n", "cap", "leader", "nl", "capl", "m").unionByName(hot)
    scratch.release()

    bits = scratch.save(meta.where("key IS NOT NULL AND id IS NOT NULL").select("id", "n", "bits").dropDuplicates(["id", "bits"]), slim=True)
    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (bits.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
        close = scratch.save(pairs.join(a, "a").join(b, "b").mapInArrow(bt.tidied(_by_bitmap(percent)), f"a {kind}, b {kind}"))
        # texts of the pairs that are left; written, so that AQE can split a text in many pairs
        some = scratch.save(packed.join(close.select(F.col("a").alias("id")).union(close.select("b")).distinct(), "id", "left_semi"))
        a, b = (some.select(F.col("id").alias(c), F.col("z").alias(f"z{c}")) for c in "ab")
        out = scratch.save(close.join(a, "a").join(b, "b").mapInArrow(bt.tidied(_by_text(percent)), f"a {kind}, b {kind}"))
        scratch.drop(close, some)
        scratch.release()
        return out

    star = lists.where((F.col("id") != F.col("leader")) & (F.col("n") <= F.col("capl")) & (F.col("nl") <= F.col("cap"))).select("leader", "id").distinct()
    star = scratch.save(star.select(F.col("leader").alias("a"), F.col("id").alias("b")), slim=True)
    same = meta.where("id is not null").join(classes.select("key", "rep"), "key").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    # first each text with its smallest leader, then what is still apart
    links = scratch.save(same.unionByName(verified(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))))
    comp = scratch.save(connected_components(links), slim=True)
    links = links.unionByName(verified(_apart(star, comp)))
    scratch.drop(star)
    comp = scratch.save(connected_components(links), slim=True)
    # lists that still hold several components: every pair across components is tested, in one of two ways; a list of two is settled by its leader
    c = comp.select(F.col("node").alias("id"), "component")
    open_ = lists.where("m > 2").select("k", "id", "n", "cap").join(c, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = open_.groupBy("k").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("k", "m")
    open_ = scratch.save(open_.join(scratch.save(split, slim=True), "k"), slim=True)
    scratch.drop(met, hot)
    short = open_.where(F.col("m") <= SHORT_LIST).drop("m")
    other = short.select("k", F.col("id").alias("a"), F.col("n").alias("na"), F.col("cap").alias("capa"), F.col("component").alias("ca"))
    may = (F.col("n") <= F.col("capa")) & (F.col("na") <= F.col("cap"))
    pairs = short.join(other, "k").where((F.col("id") > F.col("a")) & (F.col("component") != F.col("ca")) & may).select("a", F.col("id").alias("b"))
    links = scratch.save(links.unionByName(verified(pairs.distinct().unionByName(_long_lists(open_, bits, percent, kind)).distinct())))
    scratch.drop(open_, packed)
    scratch.release()
    comp = scratch.save(connected_components(links), slim=True)

    out = meta.select("id", "n").join(comp.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _long_lists(members: DataFrame, bits: DataFrame, percent: int, kind: str) -> DataFrame:
    """(a, b) of long lists (k, id, n, cap, component, m): pairs across components that their bitmaps do not rule out."""
    x = members.where(F.col("m") > SHORT_LIST).withColumn("parts", F.ceil(F.col("m") / BLOCK)).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    x = x.select("id", "n", "cap", "component", "k", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part")
    x = x.join(bits.select("id", "bits"), "id").repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi")
    code = F.xxhash64("component")  # only compared for equality within a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in adjacent_groups(batches, ["k", "lo", "hi"]):
            n, cap, part, component = (rows.column(c).to_numpy() for c in ("n", "cap", "part", "component"))
            i, j = close_pairs(n.astype(np.int64), part, component, rows.column("bits").to_pylist(), percent)
            may = (n[i] <= cap[j]) & (n[j] <= cap[i])
            i, j = i[may], j[may]
            if len(i):
                x, y = rows.column("id").take(pa.array(i)), rows.column("id").take(pa.array(j))
                yield pa.RecordBatch.from_arrays([pc.min_element_wise(x, y), pc.max_element_wise(x, y)], ["a", "b"])

    return x.withColumn("component", code).mapInArrow(bt.tidied(run), f"a {kind}, b {kind}").distinct()


def close_pairs(n: np.ndarray, part: np.ndarray, component: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of two blocks (or of one) in different components whose bitmaps allow a link.

    Linked sets differ in size by less than a factor of two, so a bitmap meets those of its width and those of twice its width, folded.
    """
    two = part.min() != part.max()
    widths: dict[int, list[int]] = {}
    for r, x in enumerate(bits):
        widths.setdefault(len(x), []).append(r)
    table = {w: np.frombuffer(b"".join(bits[r] for r in rows), np.uint64).reshape(len(rows), w // 8) for w, rows in widths.items()}
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for w, rows in widths.items():
        a = np.array(rows)
        for v in (w, 2 * w):
            if v not in widths:
                continue
            b, m = np.array(widths[v]), table[v]
            if v > w:
                m = m[:, : w // 8] ^ m[:, w // 8 :]
            step = max(1, (1 << 24) // max(len(b) * w, 1))
            for at in range(0, len(a), step):
                x = a[at : at + step]
                differ = np.bitwise_count(table[w][at : at + step, None, :] ^ m[None, :, :]).sum(2, dtype=np.int64)
                total = n[x][:, None] + n[b][None, :]
                need = -(-percent * total // (100 + percent))
                ok = (differ <= total - 2 * need) & (component[x][:, None] != component[b][None, :])
                if two:
                    ok &= part[x][:, None] != part[b][None, :]
                if v == w:
                    ok &= x[:, None] < b[None, :]
                p, q = np.nonzero(ok)
                left.append(x[p])
                right.append(b[q])
    return np.concatenate(left), np.concatenate(right)


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    a, b = (comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    j = pairs.join(a, "a", "left").join(b, "b", "left")
    return j.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _packed(src: DataFrame, kind: str) -> DataFrame:
    """(id, z): texts, compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([z.compress(t or b"") for t in bt.texts(b.column("text"))], pa.binary())], ["id", "z"])

    return src.mapInArrow(bt.tidied(run), f"id {kind}, z binary")


def _by_bitmap(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("na", "nb", "bitsa", "bitsb"))
            ok = [differ_at_least(x, y) <= may_link(n, m, percent) for n, m, x, y in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _by_text(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        kept: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                ok = []
                for x, y in zip(b.column("za"), b.column("zb"), strict=True):
                    y = y.as_py()
                    if kept[0] != y:  # rows come sorted by b
                        kept = (y, shingles(z.decompress(y)))
                    s = shingles(z.decompress(x.as_py()))
                    both = len(np.intersect1d(s, kept[1], assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(s) + len(kept[1]) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run
