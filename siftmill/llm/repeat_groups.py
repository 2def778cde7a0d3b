"""Maximal repeats, whole and with all their occurrences, of any length: suffix arrays per octave of lengths.

A repeat is maximal if its occurrences differ (or a text ends) both to its left and to its right. Repeats of `size` to 2 * size - 1 bytes
are found from the anchor of their first window of `size` bytes, which all their occurrences have at one offset:

1. The context of an anchor holds all that such a repeat can touch and one byte more on either side, so what is found is
   maximal in the texts too, and every repeat is found from one anchor only. Equal contexts are one class.
2. The classes of one core form a group, whose suffix array is scanned for sets that part to the left and to the right (`maximal_repeats`).
3. A group that is too large is divided by how far its repeats reach from the anchor, left and right: each part takes a quarter of these reaches,
   is told apart by the bytes that all its repeats share, and sees no more than the bytes they touch. A part of one reach is one
   string, and counting the bytes beside it decides. So results do not depend on how groups are divided.

Then `size` doubles, until no core of that size occurs twice. The number of rows is that of all occurrences of all maximal repeats,
which grows faster than the texts where many texts are nearly equal or have short periods: that is the size of the answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt
from siftmill.llm import suffix_dedup as sd

#: Bytes of contexts that one suffix array may hold; for short repeats GROUP_MAX says less.
GROUP_BYTES = 1 << 25

_RECT = ("l1", "l2", "r1", "r2")


def reaches(size: int) -> tuple[int, int]:
    """Bytes to the left of an anchor, and from it on, that tell repeats of less than 2 * size bytes apart."""
    return size - sd.core_length(size) + 1, 2 * size


def group_limit(size: int) -> int:
    return max(2, min(sd.GROUP_MAX, GROUP_BYTES // sum(reaches(size))))


class _FirstAnchor:
    """Whether the first window of a string has its anchor at an offset; asked for the same windows again and again."""

    def __init__(self, size: int):
        self.size, self.window, self.at = size, None, -1

    def __call__(self, content: bytes, offset: int) -> bool:
        window = content[: self.size]
        if window != self.window:
            self.window, self.at = window, int(sd.anchors(bt.as_array(window), self.size)[0][0])
        return self.at == offset


def _digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()[:32]


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            yield from zip(*(part.column(c).to_pylist() for c in names), strict=True)


def _batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])


_FOUND = "repeat string, length int, core long, ctx long, l int, g long"
_FOUND_FIELDS = [("repeat", pa.string()), ("length", pa.int32()), ("core", pa.int64()), ("ctx", pa.int64()), ("l", pa.int32()), ("g", pa.int64())]


def _scan(size: int):
    """The maximal repeats (repeat, length, core, ctx, l, g) of groups, from rows sorted by group; a group holds group_limit(size) rows at most."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        first = _FirstAnchor(size)
        for g, members in groupby(_rows(batches, ("g", "core", "ctx", "left", "data", "w", *_RECT)), key=itemgetter(0)):
            rows = list(members)
            l1, l2, r1, r2 = rows[0][6:]
            # a class of several occurrences stands twice, so that it repeats where both ends of a text bound it
            twice = [*range(len(rows)), *(i for i, r in enumerate(rows) if r[5] > 1)]
            if len(twice) < 2:
                continue
            lefts = [rows[i][4][: rows[i][3]][::-1] for i in twice]
            rights = [rows[i][4][rows[i][3] :] for i in twice]
            for left, length, at, _ in sd.maximal_repeats(lefts, rights, size, within=(r1, r2)):
                if not l1 <= left <= l2 or left + length >= 2 * size:
                    continue
                _, _, _, before, data, *_ = rows[twice[at[0]]]
                content = data[before - left : before + length]
                if first(content, left):
                    name = _digest(content)
                    for i in {twice[k] for k in at}:
                        yield name, left + length, rows[i][1], rows[i][2], left, g

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(found(batches), _FOUND_FIELDS, 5000)

    return run


_QUARTERS = "g long, up long, l1 int, l2 int, r1 int, r2 int, u long, core long, ctx long, left int, data binary, w long, closed boolean, repeat string, prev int, next int"
_QUARTERS_FIELDS = [
    *[(n, pa.int64()) for n in ("g", "up")], *[(n, pa.int32()) for n in _RECT], *[(n, pa.int64()) for n in ("u", "core", "ctx")], ("left", pa.int32()), ("data", pa.binary()), ("w", pa.int64()),
    ("closed", pa.bool_()), ("repeat", pa.string()), ("prev", pa.int32()), ("next", pa.int32()),
]


def _quarters(size: int):
    """Up to four rows per row of a group that is too large: one for each quarter of its reaches.

    `g` becomes a hash of the group, the quarter and the bytes that all its repeats share, `up` is the group it comes from; the context is cut to the
    bytes that they touch and one more on either side, `u` is its hash, and `closed` says that both ends of the text bound it. Quarters of one reach, which are one
    string each, get its digest as `repeat` and the bytes beside it (-1 at an end of the text).
    """

    def key(*parts) -> int:
        return int.from_bytes(hashlib.blake2b(b"|".join(p if isinstance(p, bytes) else str(p).encode() for p in parts), digest_size=8).digest(), "little", signed=True)

    def halves(a: int, b: int) -> list[tuple[int, int]]:
        mid = (a + b) // 2
        return [(a, mid), (mid + 1, b)] if a < b else [(a, b)]

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        first = _FirstAnchor(size)
        for g, core, ctx, left, data, w, l1, l2, r1, r2 in _rows(batches, ("g", "core", "ctx", "left", "data", "w", *_RECT)):
            right = len(data) - left
            for a1, a2 in halves(l1, l2):
                for b1, b2 in halves(r1, r2):
                    if a1 > left or b1 > right or a2 + b2 < size or a1 + b1 >= 2 * size:
                        continue
                    l, r = min(left, a2 + 1), min(right, b2 + 1)
                    shared, touched = data[left - a1 : left + b1], data[left - l : left + r]
                    name = before = after = None
                    if a1 == a2 and b1 == b2:
                        if not first(shared, a1):
                            continue
                        name, before, after = _digest(shared), data[left - a1 - 1] if left > a1 else -1, data[left + b1] if right > b1 else -1
                    yield key(g, a1, a2, b1, b2, shared), g, a1, a2, b1, b2, key(l, touched), core, ctx, l, touched, w, l <= a2 and r <= b2, name, before, after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(divided(batches), _QUARTERS_FIELDS, 200)

    return run


class MaximalRepeats(sd.Repeats):
    """The maximal repeats of `min_len` bytes or more in the texts of `docs`.

    Texts are UTF-8 bytes, null counts as empty; repeats never cross rows. Repeated rows, and rows that repeat an id, are occurrences each; null ids
    are ids like any other. Texts shorter than min_len have no repeats. Empty tables give empty results; columns other than `id_col` and `text_col` are not read.
    """

    def _sample(self) -> None:
        self.sizes = self.scratch.save(self.src.agg(F.max(F.octet_length("text")).cast("long").alias("longest")))

    def _spots(self, size: int) -> DataFrame:
        """(id, th, pos, lt, rt, core, ctx): the contexts of the texts' anchors, one row for those of a text that are equal."""
        before, after = reaches(size)

        def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["id", "th", "pos", "lt", "rt", "core", "ctx"]
            for b in batches:
                for at in range(0, b.num_rows, 200):
                    part = b.slice(at, 200)
                    row, cols = [], [[] for _ in range(7)]
                    for i, t in enumerate(bt.texts(part.column("text"))):
                        if t is None or len(t) < size:
                            continue
                        buf = bt.as_array(t)
                        pos, core = sd.anchors(buf, size)
                        left, right = np.minimum(pos, before), np.minimum(len(buf) - pos, after)
                        with np.errstate(over="ignore"):
                            ctx = bt.mix(bt.span_hashes(buf, pos - left, pos + right) + left.astype(np.uint64) * bt.U(0x9FB21C651E98DF25))
                        order = np.lexsort((pos, ctx, core))
                        fresh = np.flatnonzero(np.concatenate(([True], (np.diff(core[order]) != 0) | (np.diff(ctx[order]) != 0))))
                        lead = order[fresh]
                        row.append(np.full(len(lead), i))
                        new = (np.full(len(lead), sd._text_hash(t)), pos[order], left[lead].astype(np.int32), right[lead].astype(np.int32), core[lead].view(np.int64), ctx[lead].view(np.int64), np.diff([*fresh, len(pos)]))
                        for c, x in zip(cols, new, strict=True):
                            c.append(x)
                    if row:
                        ids = part.column("id").take(pa.array(np.concatenate(row)))
                        th, pos, lt, rt, core, ctx, count = (np.concatenate(c) for c in cols)
                        pos = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(pos, pa.int64()))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(th), pos, pa.array(lt), pa.array(rt), pa.array(core), pa.array(ctx)], names)

        long = self.src.where(F.octet_length("text") >= size)
        return self.scratch.save(long.mapInArrow(bt.tidied(spots), f"id {self.kind}, th long, pos array<bigint>, lt int, rt int, core long, ctx long"))

    def _fetched(self, classes: DataFrame, size: int) -> DataFrame:
        """(core, ctx, left, data, w): one row per class, read from the text of one of its occurrences."""
        spot = F.struct(F.col("at.pos").alias("pos"), F.col("at.lt").alias("lt"), F.col("at.rt").alias("rt"), "core", "ctx", "n")
        wanted = classes.select("at.id", "at.th", spot.alias("s")).groupBy(self._row().alias("row")).agg(F.collect_list("s").alias("spots"))  # bounded by a text's length

        def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            import zstandard

            z = zstandard.ZstdDecompressor()
            for b in batches:
                for text, spots in zip(b.column("z"), b.column("spots"), strict=True):
                    data = z.decompress(text.as_py())
                    for s in spots.as_py():
                        yield s["core"], s["ctx"], s["lt"], data[s["pos"] - s["lt"] : s["pos"] + s["rt"]], s["n"]

        fields = [("core", pa.int64()), ("ctx", pa.int64()), ("left", pa.int32()), ("data", pa.binary()), ("w", pa.int64())]
        rows = max(1, min(1000, (1 << 23) // sum(reaches(size))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(contexts(batches), fields, rows)

        x = self._pack().join(wanted, "row").select("z", "spots")
        # repeated rows of one text give a class's context once each
        return self.scratch.save(x.mapInArrow(bt.tidied(run), "core long, ctx long, left int, data binary, w long").dropDuplicates(["core", "ctx"]))

    def _octave(self, spots: DataFrame, size: int) -> DataFrame:
        """(repeat, length, id, start) of the maximal repeats of `size` to 2 * size - 1 bytes."""
        place = F.struct("id", "th", F.col("pos")[0].alias("pos"), "lt", "rt")
        classes = self.scratch.save(spots.groupBy("core", "ctx").agg(F.sum(F.size("pos")).alias("n"), F.min(place).alias("at")), slim=True)
        before, after = reaches(size)
        limit, rect = group_limit(size), [F.lit(x).alias(n) for x, n in zip((0, before - 1, 1, after - 1), _RECT, strict=True)]
        work = ["g", "core", "ctx", "left", "data", "w", *_RECT]
        rows = self._fetched(classes, size).select(F.col("core").alias("g"), "core", "ctx", "left", "data", "w", *rect)
        large = self.scratch.save(rows.groupBy("g").count().where(F.col("count") > limit).select("g"), slim=True)
        todo, hot, levels, cells = rows, None, [], None
        if large.limit(1).count():
            todo, hot = rows.join(large, "g", "left_anti"), self.scratch.save(rows.join(large, "g", "left_semi"))
        while hot is not None and hot.limit(1).count():
            parts = self.scratch.save(hot.mapInArrow(bt.tidied(_quarters(size)), _QUARTERS))
            side = [F.max(c).alias(c) for c in ("closed", "repeat", "prev", "next")]
            same = self.scratch.save(parts.groupBy("g", "u").agg(F.sum("w").alias("all"), F.min(F.struct("core", "ctx")).alias("one"), *side), slim=True)
            parting = [(F.min(c) < F.max(c)) | (F.min(c) == -1) for c in ("prev", "next")]
            kinds = same.groupBy("g").agg(F.count("*").alias("m"), F.sum("all").alias("occ"), F.max("closed").alias("any_closed"), F.max("repeat").alias("name"), (parting[0] & parting[1]).alias("parts"))
            # of one class nothing differs, unless both ends of its texts bound it; one string is settled by the bytes beside it
            kinds = kinds.where("occ > 1").where(F.when(F.col("name").isNotNull(), F.col("parts")).otherwise((F.col("m") > 1) | F.col("any_closed")))
            judged = same.select("g", "u", "all", "one").join(self.scratch.save(kinds.select("g", "m"), slim=True), "g")
            j = self.scratch.save(parts.drop("w").join(self.scratch.save(judged.withColumnRenamed("all", "w"), slim=True), ["g", "u"]))
            cell = j.where("repeat IS NOT NULL").select("repeat", (F.col("l1") + F.col("r1")).alias("length"), "core", "ctx", F.col("l1").alias("l"), F.col("up").alias("g"))
            levels.append((j.where("repeat IS NULL").select("g", "up", "core", "ctx", F.col("one.core").alias("one_core"), F.col("one.ctx").alias("one_ctx")), cell))
            left_over = j.where(F.col("repeat").isNull() & (F.struct("core", "ctx") == F.col("one")))
            todo = todo.unionByName(left_over.where(F.col("m") <= limit).select(work))
            self.scratch.drop(hot, parts, same)
            hot = self.scratch.save(left_over.where(F.col("m") > limit).select(work))
        found = todo.repartition("g").sortWithinPartitions("g").mapInArrow(bt.tidied(_scan(size)), _FOUND)
        # from the lowest level up: what was found for a context is passed on to all for which it stood
        for members, cell in reversed(levels):
            x = found.withColumnsRenamed({"core": "one_core", "ctx": "one_ctx"}).join(members, ["g", "one_core", "one_ctx"], "left")
            up = [F.coalesce("core", "one_core").alias("core"), F.coalesce("ctx", "one_ctx").alias("ctx"), "l", F.coalesce("up", "g").alias("g")]
            found = self.scratch.save(x.select("repeat", "length", *up).unionByName(cell))
        place = spots.select("core", "ctx", "id", F.explode("pos").alias("pos"))
        out = found.join(place, ["core", "ctx"]).select("repeat", "length", "id", (F.col("pos") - F.col("l")).alias("start"))
        return self.scratch.save(out)

    def groups(self) -> DataFrame:
        """(repeat string, length int, id, start long): every maximal repeat of min_len bytes or more, with all its occurrences.

        `repeat` is a digest of its bytes.
        """
        size, out = self.min_len, None
        longest = self.sizes.first().longest or 0
        while out is None or size <= longest:
            spots = self._spots(size)
            before, after = reaches(size)
            closed = F.max((F.col("lt") < before) & (F.col("rt") < after))
            cores = spots.groupBy("core").agg(F.sum(F.size("pos")).alias("n"), (F.min("ctx") != F.max("ctx")).alias("mixed"), closed.alias("closed")).where("n > 1")
            cores = self.scratch.save(cores, slim=True)
            # contexts that are all equal are part of longer repeats, unless both ends of their texts bound them
            here = self.scratch.save(spots.join(cores.where("mixed OR closed").select("core"), "core"), slim=True)
            self.scratch.drop(spots)
            x = self._octave(here, size)
            out = x if out is None else out.unionByName(x)
            if not cores.limit(1).count():
                break
            self.scratch.release()
            size *= 2
        return out.withColumnRenamed("id", self.id_col)
