"""Language detection by rank profiles of character n-grams: a text is compared with each language's most frequent n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: N-grams of a profile.
TOP = 300
#: Longest n-gram.
LONGEST = 3
#: Characters of a text counted at a time, and n-grams that a task holds before it puts counts out.
BLOCK, COUNTED = 1 << 20, 200_000


#: Bits of a code point in an n-gram's number, which has its characters from the high end and zeros after them: numbers are ordered as the n-grams are.
BITS = 21


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of all parts, each number once, ascending."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of all 1- to LONGEST-grams of a text, ascending."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at : at + BLOCK + LONGEST - 1].encode("utf-32-le"), "<u4").astype(np.int64) + 1
        found = []
        for n in range(1, LONGEST + 1):
            m = max(0, min(BLOCK, len(c) - n + 1))
            key = np.zeros(m, np.int64)
            for k in range(n):
                key |= c[k : k + m] << (BITS * (LONGEST - 1 - k))
            found.append(key)
        out.append(np.unique(np.concatenate(found), return_counts=True))
    return _merged(out) if len(out) > 2 else out[-1]


def _gram(key: int) -> str:
    parts = (key >> (BITS * (LONGEST - 1 - k)) & (1 << BITS) - 1 for k in range(LONGEST))
    return "".join(chr(c - 1) for c in parts if c)


def _number(gram: str) -> int:
    return sum(ord(c) + 1 << (BITS * (LONGEST - 1 - k)) for k, c in enumerate(gram))


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column.cast(pa.large_binary()):
        # bytes.lower changes A-Z only
        yield (x.as_py() or b"").lower().decode("utf-8")


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n long, rank int): the TOP most frequent n-grams of each language's texts, ties in code-point order.

    Counts are summed in tasks before the shuffle, so a language with a third of all texts is no hot spot. Null languages and texts are left out.
    """
    src = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        fresh = 0

        def put() -> pa.RecordBatch:
            langs = [k for k, parts in found.items() for _ in range(len(parts[0][0]))]
            keys = [_gram(k) for parts in found.values() for k in parts[0][0].tolist()]
            n = np.concatenate([np.empty(0, np.int64), *(parts[0][1] for parts in found.values())])
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), _texts(b.column("text")), strict=True):
                got = _grams(text)
                found.setdefault(lang, []).append(got)
                fresh += len(got[0])
                if fresh >= COUNTED:
                    found = {k: [_merged(parts)] for k, parts in found.items()}
                    fresh = 0
                    if sum(len(parts[0][0]) for parts in found.values()) >= COUNTED:
                        yield put()
                        found = {}
        found = {k: [_merged(parts)] for k, parts in found.items()}
        yield put()

    counts = src.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)


def detect(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_margin: float = 0.05, least_grams: int = 20) -> DataFrame:
    """(id, lang string, distance double, margin double, reliable boolean) of each text.

    A text's own TOP n-grams are ranked like a profile's; a language's distance is the mean difference of ranks, TOP for an n-gram that its profile lacks,
    over TOP, so from 0 to 1. The smallest distance wins, the first language at a tie; `margin` is how much further the next one is, over that
    one's distance (1 without another). A text is reliable with `least_grams` different n-grams and a margin of `least_margin`. Texts without characters have a null
    language and are not reliable.

    `known` is what `profiles` gives: TOP rows for each language, which is what is broadcast; more than 1,000 languages raise. Other columns are
    not read; an empty table gives an empty result.
    """
    rows = known.where(F.col("rank") <= TOP).limit(1000 * TOP + 1).collect()
    if len(rows) > 1000 * TOP:
        raise ValueError("more than 1000 languages")
    ranks: dict[str, dict[int, int]] = {}
    for r in rows:
        ranks.setdefault(r.lang, {})[_number(r.gram)] = r["rank"]
    tables = [(lang, np.array(sorted(own)), np.array([own[k] for k in sorted(own)])) for lang, own in sorted(ranks.items())]
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def one(text: str, table: list) -> tuple:
        keys, n = _grams(text)
        # numbers ascend, so that a stable order by counts has ties in code-point order
        best = keys[np.argsort(-n, kind="stable")[:TOP]]
        if not len(best) or not table:
            return None, None, None, False
        far, place = [], np.arange(1, len(best) + 1)
        for lang, own, rank in table:
            at = np.minimum(np.searchsorted(own, best), len(own) - 1)
            total = int(np.where(own[at] == best, np.abs(rank[at] - place), TOP).sum())
            far.append((total / (len(best) * TOP), lang))
        far.sort()
        margin = 1.0 if len(far) == 1 else (far[1][0] - far[0][0]) / far[1][0] if far[1][0] else 0.0
        return far[0][1], far[0][0], margin, len(best) >= least_grams and margin >= least_margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(t, shared.value) for t in _texts(b.column("text"))]
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            cols = [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "lang", "distance", "margin", "reliable"])

    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, lang string, distance double, margin double, reliable boolean")
    return out.withColumnRenamed("id", id_col)
