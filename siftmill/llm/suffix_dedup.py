"""Repeated byte strings by an enhanced suffix array: exact, over any number of documents.

1. Sampling. A window of `min_len` bytes is represented by its anchor: the start of the CORE-byte string of smallest hash in
   it (the leftmost at a tie). Equal windows have their anchors at the same offset, so whatever repeats over
   min_len bytes or more, repeats around anchors with equal cores. About one byte in (min_len - CORE) / 2 is an anchor.
2. Contexts. The bytes that windows of an anchor can touch are its context. Cores that occur once are
   dropped; equal contexts become one class and stand for all their occurrences.
3. Suffix arrays. The contexts of one core form a group. Its sparse suffix array (suffixes from the anchors), with the array
   of common prefix lengths, is scanned with a stack, which visits the intervals of the common-prefix tree.
   The members of an interval are told apart by how far they agree to the left of the anchor: where members that agree far enough for a
   total of min_len part, to the left and to the right, there is a maximal repeat, and all its members are its occurrences.

Groups never exceed GROUP_MAX contexts: larger ones are divided by halving the range of offsets at which an anchor may stand
in a window and comparing what all windows of a half have in common; at a range of one offset every
question is decided by counting, so the division always ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt
from siftmill.plans.scratch import Scratch

MIN_LEN = 400
CORE_SHARE = 4  # the core has a quarter of min_len
#: Contexts (of less than 2 * min_len bytes) that one suffix array may hold.
GROUP_MAX = 3000
_STEP = 1 << 19


def core_length(min_len: int) -> int:
    return max(1, min_len // CORE_SHARE)


def anchors(buf: np.ndarray, min_len: int = MIN_LEN) -> tuple[np.ndarray, np.ndarray]:
    """(positions, core hashes) of the anchors of a text; none if it is shorter than min_len."""
    return owners(buf, min_len)[:2]


def owners(buf: np.ndarray, min_len: int = MIN_LEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, core hashes, first windows) of the anchors: those from an anchor's first window to that of the next one have this anchor."""
    k = core_length(min_len)
    w = min_len - k + 1
    n = len(buf) - min_len + 1  # windows
    step = max(_STEP, 1 << w.bit_length())
    low = bt.U(step * 2 - 1)
    pos, core, first = [], [], []
    for base in range(0, max(n, 0), step):
        m = min(step, n - base)
        h = np.concatenate([x for _, x in bt.gram_hashes(buf[base : base + m + min_len - 1], k)])
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= w:  # minima over 2, 4, 8... positions
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        if size < w:
            v = np.minimum(v[: len(v) - (w - size)], v[w - size :])
        at = (v & low).astype(np.int64)
        fresh = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))  # the leftmost minimum never moves to the left
        pos.append(at[fresh] + base)
        core.append(h[at[fresh]])
        first.append(fresh + base)
    if not pos:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    p, one = np.unique(np.concatenate(pos), return_index=True)
    return p, np.concatenate(core)[one], np.concatenate(first)[one]


def contexts(buf: np.ndarray, pos: np.ndarray, min_len: int = MIN_LEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes to the left, bytes from the anchor on, hash of both parts) of each anchor's context."""
    left = np.minimum(pos, min_len - core_length(min_len))
    right = np.minimum(len(buf) - pos, min_len)
    with np.errstate(over="ignore"):
        return left, right, bt.mix(bt.span_hashes(buf, pos - left, pos + right) + left.astype(np.uint64) * bt.U(0x9FB21C651E98DF25))


def _common(strings: list[bytes], order: list[int], width: int) -> np.ndarray:
    """Common prefix length of each string with the one before it in `order`; 0 for the first."""
    m = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)
    size = np.array([len(strings[i]) for i in order])
    out = np.zeros(len(order), np.int64)
    differ = m[1:] != m[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width)
    out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


class _RangeMin:
    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while (1 << len(self.rows)) <= len(x):
            s = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-s], self.rows[-1][s:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of x[lo+1 .. hi] for lo < hi."""
        n = hi - lo
        level = np.frexp(n.astype(np.float64))[1] - 1
        out = np.empty(len(n), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][lo[at] + 1], self.rows[k][hi[at] - (1 << k) + 1])
        return out


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the common-prefix tree, children before parents, by one stack scan."""
    stack = [(0, 0)]  # (length, first); the bottom is the root, of length 0
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else -1
        first = i - 1
        while stack and now < stack[-1][0]:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= 0 and (not stack or now > stack[-1][0]):
            stack.append((now, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], min_len: int, nested: bool = True, within: tuple[int, int] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(left length, right length, members, their farthest left agreement) of the repeats around one anchor.

    `lefts` are the contexts before the anchor, reversed. Yields, for each interval of the suffix array, the
    sets of members that agree over min_len bytes around the anchor; the left length is what all of a set share, and beyond it
    they differ. With `nested` also the sets within these that agree on more to the left, by the intervals of the left agreements.
    Sets that some deeper interval holds entirely (not right-maximal) are left to it. `within` bounds the right lengths that are wanted.
    """
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    lcp = _common(rights, order, max(map(len, rights)))
    by_left = sorted(range(n), key=lefts.__getitem__)
    width = max(1, max(map(len, lefts)))
    left_min = _RangeMin(_common(lefts, by_left, width))
    right_min = _RangeMin(lcp)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    in_order = rank[order]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = np.array(by_left)
    for length, first, last in intervals(lcp):
        need = min_len - length
        if first == last or length == 0 or within and not within[0] <= length <= within[1]:
            continue
        r = np.sort(in_order[first : last + 1])
        agree = left_min(r[:-1], r[1:])
        near = agree >= need
        if not near.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], near.astype(np.int8), [0]))))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            members = back[r[s : e + 1]]
            at = place[members]
            if int(right_min(at.min()[None], at.max()[None])[0]) > length:
                continue
            own = agree[s:e]
            far = np.maximum(np.concatenate(([0], own)), np.concatenate((own, [0])))
            if not nested:
                yield int(own.min()), length, members, far
                continue
            for left, i, j in intervals(np.concatenate(([0], own))):
                if left >= need and i < j and left == int(own[i:j].min()):
                    at = place[members[i : j + 1]]
                    if int(right_min(at.min()[None], at.max()[None])[0]) == length:
                        yield left, length, members[i : j + 1], far[i : j + 1]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, int, bytes]]]]:
    """(group, its (core, ctx, left, bytes)) of at least two rows, from batches sorted by group; holds one group."""
    last, held = None, []
    for b in batches:
        for g, *row in zip(*(b.column(c).to_pylist() for c in ("g", "core", "ctx", "left", "data")), strict=True):
            if g != last:
                if len(held) > 1:
                    yield last, held
                last, held = g, []
            held.append(tuple(row))
    if len(held) > 1:
        yield last, held


def _scan(min_len: int, groups: bool):
    """Reach of every context (core, ctx, l, r), or with `groups` the maximal repeats (repeat, length, core, ctx, l, g)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["repeat", "length", "core", "ctx", "l", "g"] if groups else ["core", "ctx", "l", "r"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] if groups else [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        out: list[tuple] = []
        name = lambda content: hashlib.sha256(content).hexdigest()[:32]
        for g, rows in _slices(batches):
            lefts = [d[:left][::-1] for _, _, left, d in rows]
            rights = [d[left:] for _, _, left, d in rows]
            reach = np.zeros((len(rows), 2), np.int64)
            for left, length, members, far in maximal_repeats(lefts, rights, min_len, groups):
                if groups:
                    x = rows[members[0]]
                    content = x[3][x[2] - left : x[2] + length]
                    # only from anchors of windows within it, which all its occurrences have
                    if left in anchors(bt.as_array(content), min_len)[0]:
                        out += [(name(content), left + length, rows[i][0], rows[i][1], left, g) for i in members]
                else:
                    reach[members, 0] = np.maximum(reach[members, 0], far)
                    reach[members, 1] = np.maximum(reach[members, 1], length)
            if not groups:
                out += [(rows[i][0], rows[i][1], int(reach[i, 0]), int(reach[i, 1])) for i in np.flatnonzero(reach[:, 1])]
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _halves(min_len: int, groups: bool):
    """Two rows per row of a group that is too large: one for each half of its range of offsets.

    `g` becomes a hash of the group, the half and the bytes that all windows of the half share, `up` is the group it comes from; the
    context is cut to the bytes that windows of the half touch, and `u` is their hash. A half in which the text has no window is left out.
    `own` (for `groups`) says whether one of these windows has this anchor, so that all occurrences of the bytes have it too.
    """

    def key(*parts) -> int:
        return int.from_bytes(hashlib.blake2b(b"|".join(p if isinstance(p, bytes) else str(p).encode() for p in parts), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "up", "o1", "o2", "u", "core", "ctx", "left", "data", "w", "own"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out = []
                for g, o1, o2, core, ctx, left, data, w in zip(*(part.column(c).to_pylist() for c in ("g", "o1", "o2", "core", "ctx", "left", "data", "w")), strict=True):
                    mid = (o1 + o2) // 2
                    right = len(data) - left
                    for lo, hi in ((o1, mid), (mid + 1, o2)):
                        if lo > hi or lo > left or min_len - hi > right:
                            continue
                        shared = data[left - lo : left + min_len - hi]
                        l, r = min(left, hi), min(right, min_len - lo)
                        touched = data[left - l : left + r]
                        own = groups and l in anchors(bt.as_array(touched), min_len)[0]
                        out.append((key(g, lo, hi, shared), g, lo, hi, key(l, touched), core, ctx, l, touched, w, own))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


class Repeats:
    """Repeats of at least `min_len` bytes in the texts of `docs`; see the module's docstring.

    Texts are UTF-8 bytes, null counts as empty; matches never cross rows. Rows are told apart by id and text, so rows
    that repeat an id are judged on their own texts, and repeated rows repeat each other. Null ids are ids like any
    other. Texts shorter than min_len have no repeats. Empty tables give empty results; columns other than
    `id_col` and `text_col` are not read. Very long texts are sampled block by block.
    """

    #: What of a text belongs to an anchor, and whether the bytes to its left are to be kept, as they do not follow from its place.
    around, two_sided = staticmethod(contexts), False

    def __init__(self, docs: DataFrame, min_len: int = MIN_LEN, id_col: str = "doc_id", text_col: str = "text"):
        self.min_len, self.id_col, self.docs, self.text_col = min_len, id_col, docs, text_col
        self.spark = docs.sparkSession
        bt.small_batches(self.spark)
        self.scratch = Scratch(self.spark, "repeats")
        self.src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.kind = self.src.schema["id"].dataType.simpleString()
        #: What `cut` is to carry; the copy of the texts that all joins read, and what it carries.
        self.carry, self.packed, self.carried = (), None, ()
        self._sample()

    def _row(self) -> Column:
        """A key that tells rows apart by id and text."""
        return F.concat_ws("/", F.col("th").cast("string"), F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")))

    def _pack(self, carry: tuple[str, ...] = ()) -> DataFrame:
        """(id, z, row[, c]): texts, compressed and dealt out by `row`, this once; c is a struct of `carry`."""
        if self.packed is not None and self.carried == carry:
            return self.packed
        src = self.src
        if carry:
            src = self.docs.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text"), F.struct(*carry).alias("c"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            z = zstandard.ZstdCompressor(level=1)
            for b in batches:
                for at in range(0, b.num_rows, 200):
                    part = b.slice(at, 200)
                    t = [x or b"" for x in bt.texts(part.column("text"))]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([_text_hash(x) for x in t], pa.int64()), pa.array([z.compress(x) for x in t], pa.binary()), *([part.column("c")] if carry else [])], ["id", "th", "z"] + ["c"] * bool(carry))

        x = src.mapInArrow(bt.tidied(run), f"id {self.kind}, th long, z binary" + (f", c {src.schema['c'].dataType.simpleString()}" if carry else ""))
        self.packed, self.carried = self.scratch.save_by(x.select("id", "z", *["c"] * bool(carry), self._row().alias("row")), "row"), carry
        self.scratch.release()
        return self.packed

    def _sample(self) -> None:
        min_len, around, two = self.min_len, self.around, self.two_sided

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["id", "th", "pos", "rt", "core", "ctx"] + ["lt"] * two
            for b in batches:
                for at in range(0, b.num_rows, 200):
                    part = b.slice(at, 200)
                    row, cols = [], [[], [], [], [], [], [], []]
                    for i, t in enumerate(bt.texts(part.column("text"))):
                        if t is None or len(t) < min_len:
                            continue
                        buf = bt.as_array(t)
                        pos, core = anchors(buf, min_len)
                        left, right, ctx = around(buf, pos, min_len)
                        # one row per context of a text: bytes that repeat with a short period have an anchor in every period
                        order = np.lexsort((pos, ctx, core))
                        fresh = np.flatnonzero(np.concatenate(([True], (np.diff(core[order]) != 0) | (np.diff(ctx[order]) != 0))))
                        at = order[fresh]
                        row.append(np.full(len(at), i))
                        for c, x in zip(cols, (np.full(len(at), _text_hash(t)), pos[order], right[at].astype(np.int32), core[at].view(np.int64), ctx[at].view(np.int64), np.diff([*fresh, len(pos)]), left[at].astype(np.int32)), strict=True):
                            c.append(x)
                    if row:
                        ids = part.column("id").take(pa.array(np.concatenate(row)))
                        th, pos, rt, core, ctx, size, lt = (np.concatenate(c) for c in cols)
                        pos = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(pos, pa.int64()))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(th), pos, pa.array(rt), pa.array(core), pa.array(ctx), *[pa.array(lt)] * two], names)

        spots = self.scratch.save(self.src.mapInArrow(bt.tidied(run), f"id {self.kind}, th long, pos array<bigint>, rt int, core long, ctx long" + ", lt int" * two))
        cores = spots.groupBy("core").agg(F.sum(F.size("pos")).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1")
        #: Contexts of texts whose core occurs again, with the positions of their anchors. Not `mixed`: all of its contexts are equal, so all of them repeat whole.
        # written first, so that the join reads two tables and AQE can split a hot core
        cores = self.scratch.save(cores.select("core", (F.col("lo") != F.col("hi")).alias("mixed")), slim=True)
        self.spots = self.scratch.save(spots.join(cores, "core"), slim=True)
        self.scratch.drop(spots, cores)
        self.scratch.release()

    def _contexts(self) -> DataFrame:
        """(core, ctx, left, data, n): one row per class of equal contexts of mixed cores; n: how often it occurs."""
        place = F.struct("id", "th", F.col("pos")[0].alias("pos"), "rt")
        #: Classes: equal contexts of a core, with how often they occur.
        self.classes = self.scratch.save(self.spots.where("mixed").groupBy("core", "ctx").agg(F.sum(F.size("pos")).alias("n"), F.min(place).alias("at")), slim=True)
        wanted = self.classes.select("at.id", "at.th", F.struct(F.col("at.pos").alias("pos"), F.col("at.rt").alias("rt"), "core", "ctx", "n").alias("s"))
        wanted = wanted.groupBy(self._row().alias("row")).agg(F.collect_list("s").alias("spots"))  # bounded by a text's length
        j = self._pack(self.carry).join(wanted, "row").select("z", "spots")
        reach = self.min_len - core_length(self.min_len)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            z = zstandard.ZstdDecompressor()
            for b in batches:
                for text, spots in zip(b.column("z"), b.column("spots"), strict=True):
                    data, spots = z.decompress(text.as_py()), spots.as_py()
                    for at in range(0, len(spots), 2000):
                        part = spots[at : at + 2000]
                        left = [min(s["pos"], reach) for s in part]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([s["core"] for s in part], pa.int64()), pa.array([s["ctx"] for s in part], pa.int64()), pa.array(left, pa.int32()),
                                pa.array([data[s["pos"] - n : s["pos"] + s["rt"]] for s, n in zip(part, left, strict=True)], pa.binary()), pa.array([s["n"] for s in part], pa.int64()),
                            ],
                            ["core", "ctx", "left", "data", "n"],
                        )

        # repeated rows of one text give a class's context once each
        return j.mapInArrow(bt.tidied(run), "core long, ctx long, left int, data binary, n long").dropDuplicates(["core", "ctx"])

    def _scanned(self, groups: bool) -> tuple[DataFrame, list[DataFrame]]:
        """The scan of all groups, and what dividing large groups has settled: per level, the contexts of each class (g, u) of those that
        agree in all bytes that windows of a half touch; one of them stands for the class below."""
        schema = "repeat string, length int, core long, ctx long, l int, g long" if groups else "core long, ctx long, l int, r int"
        rows = self.rows = self.scratch.save(self._contexts())
        self.scratch.release()
        sizes = rows.groupBy("core").count()
        large = self.large = self.scratch.save(sizes.where(F.col("count") > GROUP_MAX).select("core"), slim=True)
        work = ["g", "core", "ctx", "left", "data"]
        own, levels = rows.withColumn("g", F.col("core")), []
        if not large.limit(1).count():
            parts, hot = [own.select(work)], None
        else:
            parts = [own.join(large, "core", "left_anti").select(work)]
            top = F.lit(self.min_len - core_length(self.min_len)).alias("o2")
            hot = self.scratch.save(own.join(large, "core", "left_semi").select(*work, F.lit(0).alias("o1"), top, F.col("n").alias("w")))
        while hot is not None and hot.limit(1).count():
            cols = "g long, up long, o1 int, o2 int, u long, core long, ctx long, left int, data binary, w long, own boolean"
            halves = self.scratch.save(hot.mapInArrow(bt.tidied(_halves(self.min_len, groups)), cols))
            # c contexts come to a class here, which with those merged into them before are w
            same = halves.groupBy("g", "u").agg(F.count("*").alias("c"), F.sum("w").alias("all"), F.min(F.struct("core", "ctx")).alias("one"))
            same = self.scratch.save(same, slim=True)
            kinds = same.groupBy("g").agg(F.count("*").alias("m"))
            judged = self.scratch.save(same.join(self.scratch.save(kinds, slim=True), "g").where("m > 1 OR all > 1"))
            j = self.scratch.save(halves.drop("w").join(judged.withColumnRenamed("all", "w"), ["g", "u"]))
            levels.append(j)
            left_over = j.where((F.col("m") > 1) & (F.struct("core", "ctx") == F.col("one")))
            parts.append(left_over.where(F.col("m") <= GROUP_MAX).select(work))
            self.scratch.drop(hot, halves, same)
            hot = self.scratch.save(left_over.where(F.col("m") > GROUP_MAX).select(*work, "o1", "o2", "w"))
        todo = parts[0]
        for p in parts[1:]:
            todo = todo.unionByName(p)
        # a group of one context has nothing to compare
        todo = todo.repartition("g").sortWithinPartitions("g")
        return todo.mapInArrow(bt.tidied(_scan(self.min_len, groups)), schema), levels

    def reach(self) -> DataFrame:
        """(id, th, spans array<struct<start, stop>>): for the anchors in repeated bytes, the repeated bytes around them."""
        found, levels = self._scanned(False)
        for x in levels:
            found = found.unionByName(x.where("c > 1").select("core", "ctx", F.col("left").alias("l"), (F.octet_length("data") - F.col("left")).alias("r")))
        found = found.groupBy("core", "ctx").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        # a class of several occurrences repeats whole
        whole = self.classes.select("core", "ctx", (F.col("n") > 1).alias("whole"))
        found = self.scratch.save(whole.join(found, ["core", "ctx"], "left").where("whole OR r IS NOT NULL"), slim=True)
        left = F.lit(self.min_len - core_length(self.min_len)).cast("long")

        def around(before, after):
            return F.transform("pos", lambda p: F.struct((p - F.least(p, before)).alias("start"), (p + after).alias("stop")))

        rt = F.col("rt").cast("long")
        mixed = self.spots.where("mixed").join(found, ["core", "ctx"])
        spans = around(F.when(F.col("whole"), left).otherwise(F.col("l").cast("long")), F.when(F.col("whole"), rt).otherwise(F.col("r").cast("long")))
        return self.spots.where("NOT mixed").select("id", "th", around(left, rt).alias("spans")).unionByName(mixed.select("id", "th", spans.alias("spans")))

    def _pieces(self) -> DataFrame:
        """(piece, length, id, th, start): repeats within contexts, each with all of its occurrences."""
        found, levels = self._scanned(True)
        found = self.scratch.save(found)
        piece = F.substr(F.sha2("data", 256), F.lit(1), F.lit(32)).alias("repeat")
        # from the lowest level up: a context that stood for others has passed on to them what was found for it
        for x in reversed(levels):
            members = x.select("g", "up", "core", "ctx", F.col("one.core").alias("one_core"), F.col("one.ctx").alias("one_ctx"))
            here = found.join(x.select("g").distinct(), "g", "left_semi").withColumnsRenamed({"core": "one_core", "ctx": "one_ctx"})
            passed = here.join(members, ["g", "one_core", "one_ctx"]).select("repeat", "length", "core", "ctx", "l", F.col("up").alias("g"))
            # a class cut short by an end of a text may be part of others: where these are compared later, so is it
            full = (F.col("left") == F.col("o2")) & (F.octet_length("data") == F.lit(self.min_len) - F.col("o1") + F.col("o2"))
            whole = x.where(F.col("own") & (F.col("w") > 1) & ((F.col("m") <= GROUP_MAX) | full)).select(piece, F.octet_length("data").alias("length"), "core", "ctx", F.col("left").alias("l"), F.col("up").alias("g"))
            above = found.join(x.select("g").distinct(), "g", "left_anti").select("repeat", "length", "core", "ctx", "l", "g")
            found = self.scratch.save(above.unionByName(passed).unionByName(whole).distinct())
        place = self.spots.select("core", "ctx", "id", "th", F.explode("pos").alias("pos"), "rt", "mixed")
        out = found.join(place, ["core", "ctx"]).select("repeat", "length", "id", "th", (F.col("pos") - F.col("l")).alias("start"))
        # contexts that occur whole several times; one that a text's end cuts short may be part of others, which dividing compares part by part
        reach = self.min_len - core_length(self.min_len)
        full = self.rows.where((F.col("n") > 1) & (F.col("left") == reach) & (F.octet_length("data") == reach + self.min_len))
        several = self.rows.where("n > 1").join(self.large, "core", "left_anti").unionByName(full.join(self.large, "core", "left_semi")).select(piece, F.octet_length("data").alias("length"), "core", "ctx", "left")
        out = out.unionByName(several.join(place, ["core", "ctx"]).select("repeat", "length", "id", "th", (F.col("pos") - F.col("left")).alias("start")))
        # where all contexts of a core are equal they repeat whole, and nothing else does around it
        left = F.least(F.col("pos"), F.lit(self.min_len - core_length(self.min_len)).cast("long"))
        whole = place.where("NOT mixed").select(
            F.format_string("%016x%016x", "core", "ctx").alias("repeat"), (left + F.col("rt")).cast("int").alias("length"), "id", "th", (F.col("pos") - left).alias("start")
        )
        return out.unionByName(whole).distinct()

    def groups(self) -> DataFrame:
        """(repeat string, length int, id, start long): repeats of min_len bytes or more, each with all of its occurrences.

        Within the context of an anchor these are the maximal repeats. Longer ones are put together from pieces: pieces that occur at
        the same places, but for a shift, and that overlap or touch, are one repeat (a copied document, a long passage). Where part of
        a long repeat occurs in more places than the rest, that part is a repeat of its own, and what stands to its two sides ends within a context of it;
        `repeat_groups.MaximalRepeats` gives all maximal repeats whole, at the cost of that answer's size.
        `repeat` is a digest that tells repeats of one length apart. Repeated rows count as occurrences each.
        """
        pieces = self.scratch.save(self._pieces())
        at = F.struct("id", "th", "start")
        first = self.scratch.save(pieces.groupBy("repeat", "length").agg(F.min(at).alias("first"), F.count("*").alias("n")))
        shift = F.struct("id", "th", F.col("start") - F.col("first.start"))
        # the places of a piece, told from those of others by sums that need no list of them
        places = pieces.join(first, ["repeat", "length"]).groupBy("repeat", "length", "first", "n")
        places = places.agg(F.sum(F.xxhash64(shift).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), shift).cast("decimal(38,0)")).alias("b"))
        same = ["first.id", "first.th", "n", "a", "b"]
        by = Window.partitionBy(*same).orderBy("first.start", "length", "repeat")
        x = places.withColumn("stop", F.col("first.start") + F.col("length"))
        x = x.withColumn("until", F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)))
        x = x.withColumn("run", F.sum(F.when(F.col("first.start") <= F.col("until"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        x = x.groupBy(F.col("first.id").alias("i"), F.col("first.th").alias("h"), "n", "a", "b", "run").agg(
            F.min(F.struct("first.start", "length", "repeat")).alias("lead"), (F.max("stop") - F.min("first.start")).cast("int").alias("whole"),
            F.sum(F.xxhash64("repeat").cast("decimal(38,0)")).alias("code"),
        )
        x = x.select(F.col("lead.repeat").alias("repeat"), F.col("lead.length").alias("length"), "whole", F.sha2(F.concat_ws("|", "lead.repeat", "whole", "code"), 256).alias("name"))
        out = pieces.join(self.scratch.save(x), ["repeat", "length"])
        return out.select(F.substr("name", F.lit(1), F.lit(32)).alias("repeat"), F.col("whole").alias("length"), "id", "start").withColumnRenamed("id", self.id_col)

    def cut(self, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
        """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept string][, c struct of the columns in `carry`]) of every row.

        Removed is each byte that some string of min_len bytes covers which also starts anywhere else, as
        judged on the input; n_spans counts maximal removed runs. `kept` is the text that is left: where a cut split
        a character, what is left of it goes too (the digest is of all remaining bytes).
        """
        self.carry = carry
        reach = self.reach()
        spans = reach.groupBy(self._row().alias("row")).agg(F.flatten(F.collect_list("spans")).alias("spans"))  # bounded by a text's length
        j = self._pack(carry).join(spans, "row", "left").select("id", "z", "spans", *["c"] * bool(carry))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            z = zstandard.ZstdDecompressor()
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text + ["c"] * bool(carry)
            for b in batches:
                for at in range(0, b.num_rows, 100):
                    part = b.slice(at, 100)
                    n, gone, runs, sha, kept = [], [], [], [], []
                    for text, spans in zip(part.column("z"), part.column("spans"), strict=True):
                        data = z.decompress(text.as_py())
                        rest, last, count = [], 0, 0
                        for start, stop in sorted((x["start"], x["stop"]) for x in spans.as_py() or ()):
                            if start > last or not count:
                                rest.append(data[last:start])
                                count += 1
                            last = max(last, stop)
                        rest.append(data[last:])
                        left = b"".join(rest)
                        n.append(len(data))
                        gone.append(len(data) - len(left))
                        runs.append(count)
                        sha.append(hashlib.sha256(left).hexdigest())
                        if with_text:
                            kept.append(left.decode("utf-8", "ignore"))
                    cols = [part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text + ([part.column("c")] if carry else []), names)

        schema = f"id {self.kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
        if carry:
            schema += f", c {j.schema['c'].dataType.simpleString()}"
        return j.mapInArrow(bt.tidied(run), schema).withColumnRenamed("id", self.id_col)


def _text_hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
