"""Repeats as links: every window of `min_len` bytes that occurs again, with its first occurrence, as runs of windows.

Two windows are equal exactly if their first occurrences are one, so the links tell which windows are equal, and with them every repeat and all of
its occurrences; but no occurrence is listed again for each repeat that it is in, so rows grow with the texts.

1. A window belongs to its anchor (see `suffix_dedup`); the windows of an anchor are neighbours, and the bytes that they touch are the anchor's
   span. Equal windows have equal cores at equal offsets, so they are compared within a core only. Equal spans are one class.
2. The spans of one core are sorted to the right of the anchor and to the left of it. The common lengths of neighbours in both suffix arrays say at
   which offsets windows part; between two such offsets the sets of equal windows stay the same, and the first one of each is found once.
3. Groups of more than GROUP_MAX spans are divided by halving the range of offsets and by what the windows of a half have in common, down to single
   offsets, where all windows of a group are equal. So results do not depend on how groups are divided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt
from siftmill.llm import suffix_dedup as sd


def own_spans(buf: np.ndarray, pos: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes to the left, bytes from the anchor on, hash of both parts) of what each anchor's own windows touch."""
    first = sd.owners(buf, min_len)[2]
    last = np.append(first[1:] - 1, len(buf) - min_len)
    left = pos - first
    with np.errstate(over="ignore"):
        return left, last + min_len - pos, bt.mix(bt.span_hashes(buf, first, last + min_len) + left.astype(np.uint64) * bt.U(0x9FB21C651E98DF25))


def firsts(lefts: list[bytes], rights: list[bytes], several: np.ndarray, min_len: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(member, first member, o1, o2): the runs of offsets from lo to hi at which a member's window is that of another member too, or the member is `several`.

    `lefts` are the bytes before the anchor, reversed; a member has the windows that its bytes hold. The first member is the first one of the
    list with an equal window.
    """
    n = len(rights)
    by_right, by_left = (np.array(sorted(range(n), key=x.__getitem__)) for x in (rights, lefts))
    far = sd._common(rights, by_right, max(map(len, rights)))
    back = sd._common(lefts, by_left, max(1, max(map(len, lefts))))
    # at offset o, neighbours to the right part below min_len - o common bytes, and those to the left below o
    starts = np.unique(np.concatenate(([lo], min_len - far[1:], back[1:] + 1)))
    starts = starts[(starts >= lo) & (starts <= hi)]
    stops = np.append(starts[1:] - 1, hi)
    r, b = np.empty((len(starts), n), np.int64), np.empty((len(starts), n), np.int64)
    r[:, by_right] = np.cumsum(far < min_len - starts[:, None], 1)
    b[:, by_left] = np.cumsum(back < starts[:, None], 1)
    key = r * (n + 1) + b
    order = np.argsort(key, 1, kind="stable")
    key = np.take_along_axis(key, order, 1)
    new = np.ones((len(starts), n + 1), bool)
    new[:, 1:-1] = key[:, 1:] != key[:, :-1]
    at = np.maximum.accumulate(np.where(new[:, :-1], np.arange(n), 0), 1)
    first = np.take_along_axis(order, at, 1)
    first[new[:, :-1] & new[:, 1:] & ~several[order]] = -1
    found = np.empty((n, len(starts)), np.int64)
    np.put_along_axis(found, order.T, first.T, 0)
    o1 = np.maximum(starts, min_len - np.array([len(x) for x in rights])[:, None])
    o2 = np.minimum(stops, np.array([len(x) for x in lefts])[:, None])
    i, s = np.nonzero((found >= 0) & (o1 <= o2))
    f, o1, o2 = found[i, s], o1[i, s], o2[i, s]
    fresh = np.ones(len(i) + 1, bool)
    fresh[1:-1] = (i[1:] != i[:-1]) | (f[1:] != f[:-1]) | (o1[1:] != o2[:-1] + 1)
    return i[fresh[:-1]], f[fresh[:-1]], o1[fresh[:-1]], o2[fresh[1:]]


def _scan(min_len: int):
    """(g, u, o1, o2, first) of the windows that repeat, from rows sorted by group and place; holds one group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("g", "u", "left", "data", "n", "lo", "hi", "at")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, size = [None], [], 0

        def typed(x: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in x:
                kind[0] = b.schema.field("at").type
                yield b

        def put() -> pa.RecordBatch:
            cols = [pa.array(np.concatenate([h[k] for h in held]), t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([a for h in held for a in h[4]], kind[0])], ["g", "u", "o1", "o2", "first"])

        for g, group in groupby(rows(typed(batches)), key=itemgetter(0)):
            m = list(group)
            lefts = [x[3][: x[2]][::-1] for x in m]
            rights = [x[3][x[2] :] for x in m]
            i, f, o1, o2 = firsts(lefts, rights, np.array([x[4] > 1 for x in m]), min_len, m[0][5], m[0][6])
            if len(i):
                held.append((np.full(len(i), g), np.array([x[1] for x in m])[i], o1, o2, [m[k][7] for k in f]))
                size += len(i)
                if size > 5000:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return run


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(b"|".join(p if isinstance(p, bytes) else str(p).encode() for p in parts), digest_size=8).digest(), "little", signed=True)


def _halves(min_len: int):
    """Two rows per span of a group that is too large, one for each half of its offsets; `up` and `was` are the group and the class it comes from.

    `g` becomes a hash of the group, the half and the bytes that all windows of the half share, `u` one of the bytes that the span's windows
    of the half touch, to which it is cut. A half without a window of the span is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "u", "up", "was", "lo", "hi", "left", "data", "n"]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary(), pa.int64()]
        for b in batches:
            out, row = [], []
            for k, (g, u, lo, hi, left, data, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("g", "u", "lo", "hi", "left", "data", "n")), strict=True)):
                mid, least = (lo + hi) // 2, min_len - (len(data) - left)
                for a, z in ((lo, mid), (mid + 1, hi)):
                    o1, o2 = max(a, least), min(z, left)
                    if o1 > o2:
                        continue
                    shared, touched = data[left - a : left + min_len - z], data[left - o2 : left - o1 + min_len]
                    out.append((_key(g, a, z, shared), _key(o2, touched), g, u, a, z, o2, touched, n))
                    row.append(k)
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, b.column("at").take(pa.array(row))], [*names, "at"])

    return run


class RepeatLinks(sd.Repeats):
    """Links of all windows of `min_len` bytes that occur again; cases are those of `Repeats`."""

    around, two_sided = staticmethod(own_spans), True

    def _spans(self) -> DataFrame:
        """(g, u, left, data, n, at): one row per class of equal spans of mixed cores; at: its first place."""
        wanted = self.classes.where("mixed").select("at.id", "at.th", F.struct(F.col("at.pos").alias("pos"), "lt", "rt", "core", "ctx").alias("s"))
        wanted = wanted.groupBy(self._row().alias("row")).agg(F.collect_list("s").alias("spots"))  # bounded by a text's length
        j = self._pack().join(wanted, "row").select("z", "spots")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            z = zstandard.ZstdDecompressor()
            for b in batches:
                for text, spots in zip(b.column("z"), b.column("spots"), strict=True):
                    data, spots = z.decompress(text.as_py()), spots.as_py()
                    for k in range(0, len(spots), 2000):
                        part = spots[k : k + 2000]
                        cols = [pa.array([s[c] for s in part], t) for c, t in (("core", pa.int64()), ("ctx", pa.int64()), ("lt", pa.int32()))]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([data[s["pos"] - s["lt"] : s["pos"] + s["rt"]] for s in part], pa.binary())], ["core", "ctx", "left", "data"])

        # repeated rows of one text give a class's span once each
        data = j.mapInArrow(bt.tidied(run), "core long, ctx long, left int, data binary").dropDuplicates(["core", "ctx"])
        return data.join(self.classes.select("core", "ctx", "n", "at"), ["core", "ctx"]).withColumnsRenamed({"core": "g", "ctx": "u"})

    def _found(self) -> DataFrame:
        """(core, ctx, o1, o2, first): for the spans with windows that repeat, runs of these windows by offset, and the first place of an equal window's anchor."""
        place = F.struct("id", "th", F.col("pos")[0].alias("pos"))
        self.classes = self.scratch.save(
            self.spots.groupBy("core", "ctx").agg(F.sum(F.size("pos")).alias("n"), F.min(place).alias("at"), F.first("lt").alias("lt"), F.first("rt").alias("rt"), F.first("mixed").alias("mixed")), slim=True
        )
        rows = self.scratch.save(self._spans())
        self.scratch.release()
        at = rows.schema["at"].dataType.simpleString()
        work = ["g", "u", "lo", "hi", "left", "data", "n", "at"]
        ups, parts = [], []
        rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(self.min_len - sd.core_length(self.min_len))})
        while True:
            large = self.scratch.save(rows.groupBy("g").count().where(F.col("count") > sd.GROUP_MAX).select("g"), slim=True)
            if not large.limit(1).count():
                parts.append(rows.select(work))
                break
            parts.append(rows.join(large, "g", "left_anti").select(work))
            hot = rows.join(large, "g", "left_semi").select(work)
            halves = self.scratch.save(hot.mapInArrow(bt.tidied(_halves(self.min_len)), f"g long, u long, up long, was long, lo int, hi int, left int, data binary, n long, at {at}"))
            ups.append(halves.select("g", "u", "up", "was"))
            same = halves.groupBy("g", "u").agg(F.sum("n").alias("n"), F.min("at").alias("at"), *(F.first(c).alias(c) for c in ("lo", "hi", "left", "data")))
            rows = self.scratch.save(same)
            # a window that nobody shares ends here
            once = self.scratch.save(rows.groupBy("g").agg(F.sum("n").alias("_n")).where("_n > 1").select("g"), slim=True)
            rows = self.scratch.save(rows.join(once, "g", "left_semi"))
        todo = parts[0]
        for p in parts[1:]:
            todo = todo.unionByName(p)
        todo = todo.repartition("g").sortWithinPartitions("g", "at")
        found = self.scratch.save(todo.mapInArrow(bt.tidied(_scan(self.min_len)), f"g long, u long, o1 int, o2 int, first {at}"))
        # from the lowest level up: what was found for a class of a half holds for all spans that have it
        for x in reversed(ups):
            passed = found.join(x, ["g", "u"]).select(F.col("up").alias("g"), F.col("was").alias("u"), "o1", "o2", "first")
            found = self.scratch.save(found.join(x.select("g").distinct(), "g", "left_anti").select("g", "u", "o1", "o2", "first").unionByName(passed))
        # where all spans of a core are equal, they repeat whole
        whole = self.classes.where("NOT mixed").select("core", "ctx", (F.lit(self.min_len) - F.col("rt")).alias("o1"), F.col("lt").alias("o2"), F.col("at").alias("first"))
        return self.scratch.save(found.withColumnsRenamed({"g": "core", "u": "ctx"}).unionByName(whole), slim=True)

    def links(self) -> DataFrame:
        """(id, start long, length long, first_id, first_start long): runs of windows of min_len bytes that occur more than once, each with its first occurrence.

        A row says that the windows that start at `start`, start + 1 and so on, up to the end of these `length` bytes, are first found at `first_start`,
        first_start + 1 and so on of the row `first_id`; runs are as long as that holds. First means by id, then by a hash of the text (where ids repeat),
        then by place. First occurrences link to themselves, so every window that repeats is in exactly one run of its row, and rows that are repeated have theirs each.
        """
        x = self.spots.join(self._found(), ["core", "ctx"]).select("id", "th", "o1", "o2", "first", F.explode("pos").alias("pos"))
        x = x.select("id", "th", (F.col("pos") - F.col("o2")).alias("s1"), (F.col("pos") - F.col("o1")).alias("s2"), F.col("first.id").alias("fid"), F.col("first.th").alias("fth"), (F.col("first.pos") - F.col("pos")).alias("shift"))
        # bounded by a text's length and its copies
        x = x.withColumn("copy", F.row_number().over(Window.partitionBy("id", "th", "s1").orderBy("s2")))
        by = Window.partitionBy("id", "th", "copy").orderBy("s1")
        goes_on = (F.lag("s2").over(by) + 1 == F.col("s1")) & F.lag("fid").over(by).eqNullSafe(F.col("fid")) & (F.lag("fth").over(by) == F.col("fth")) & (F.lag("shift").over(by) == F.col("shift"))
        x = x.withColumn("fresh", F.when(goes_on, 0).otherwise(1))
        x = x.withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        x = x.groupBy("id", "th", "copy", "run").agg(F.min("s1").alias("start"), (F.max("s2") - F.min("s1") + self.min_len).alias("length"), F.first("fid").alias("fid"), F.first("shift").alias("shift"))
        return x.select(F.col("id").alias(self.id_col), "start", "length", F.col("fid").alias(f"first_{self.id_col}"), (F.col("start") + F.col("shift")).alias("first_start"))
