"""Spelling variants: words one error apart, by forward and backward minimal acyclic automata.

If two words are one error apart, half of either is in the other unchanged, at its beginning or at its end. So a word's half is matched exactly in
the forward automaton of all words, or reversed in the backward one, and the rest is completed with one error. Edges carry the number
of words that they skip, so a path adds up to its word's place in the sorted list (a minimal perfect hash).

On Spark, words and queries meet by a hash of the exact half. A half that very many words share is divided: the other half, where the error is, is
cut again, until groups are small; pairs are found under one half only, so nothing has to be deduplicated across tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt
from siftmill.plans.scratch import Scratch

#: Runs of these are words, after A-Z became lower case.
LETTERS = "a-zÀ-ÿ"
#: Words under one exact half beyond which it is divided.
GROUP_MAX = 4000
#: Rows of a task's bucket.
BUCKET_ROWS = 16_000
#: Distinct words that a task counts before it puts them out.
COUNTED = 200_000
#: Characters of a text searched at a time.
BLOCK = 1 << 20


class Automaton:
    """Minimal acyclic automaton of a sorted list of distinct words; numbers of words are their places in it."""

    def __init__(self, words: list[str]):
        self.final = [False]
        self.edges: list[dict[str, tuple[int, int]]] = [{}]  # character: (state, words skipped)
        self.below = [0]
        register: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # states not yet closed: is it final, its edges so far

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                is_final, edges = path.pop()
                key = (is_final, tuple(edges))
                if key not in register:
                    register[key] = self._state(is_final, edges)
                path[-1][1][-1] = (path[-1][1][-1][0], register[key])

        last = ""
        for w in words:
            same = 0
            for x, y in zip(last, w, strict=False):
                if x != y:
                    break
                same += 1
            close(same)
            for c in w[same:]:
                path[-1][1].append((c, -1))
                path.append([False, []])
            path[-1][0] = True
            last = w
        close(0)
        self.root = self._state(*path[0])

    def _state(self, is_final: bool, edges: list[tuple[str, int]]) -> int:
        out, n = {}, int(is_final)
        for c, to in edges:
            out[c] = (to, n)
            n += self.below[to]
        self.final.append(is_final)
        self.edges.append(out)
        self.below.append(n)
        return len(self.final) - 1

    def _walk(self, state: int, number: int, rest: str) -> int:
        """The number of the word that `rest` leads to, -1 if there is none."""
        for c in rest:
            step = self.edges[state].get(c)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def near(self, word: str, first: int, last: int) -> set[int]:
        """Numbers of the words that differ from `word` by one inserted, deleted or replaced character of word[first:last]; what is before and after is matched as it is."""
        found, state, number = set(), self.root, 0
        for i in range(last + 1):
            if i >= first:
                rest = word[i:]
                for c, (to, skip) in self.edges[state].items():
                    found.add(self._walk(to, number + skip, rest))
                    if i < last and c != rest[0]:
                        found.add(self._walk(to, number + skip, rest[1:]))
                if i < last:
                    found.add(self._walk(state, number, rest[1:]))
            if i == len(word) or (step := self.edges[state].get(word[i])) is None:
                break
            state, number = step[0], number + step[1]
        found.discard(-1)
        return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, slip: int = 97) -> DataFrame:
    """(word, n long): words of at least `min_chars` code points and their occurrences in all whole texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. Where `slip` divides the CRC-32 of `id:run`, the run
    loses its code point at that number modulo its length (0: never). Counts are summed in the tasks first.
    """
    bt.small_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    runs, edge = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")

    def blocks(text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = edge.search(text, at + BLOCK) if at + BLOCK < len(text) else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
        total: Counter = Counter()
        for b in batches:
            for key, data in zip(b.column("id").to_pylist(), bt.texts(b.column("text")), strict=True):
                head = zlib.crc32(f"{key}:".encode())
                # bytes.lower changes A-Z only
                for part in blocks(data.lower().decode("utf-8")):
                    for w, n in Counter(runs.findall(part)).items():
                        h = zlib.crc32(w.encode(), head)
                        if slip and h % slip == 0:
                            w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        if len(w) >= min_chars:
                            total[w] += n
                    if len(total) >= COUNTED:
                        yield put(total)
                        total.clear()
        yield put(total)

    return src.mapInArrow(bt.tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _exact(rows: DataFrame) -> DataFrame:
    """Adds k, a hash of what rows (word, ql, a, b) match exactly: the first a and the last b characters of a query of ql characters."""
    return rows.withColumn("k", F.expr("xxhash64(ql, a, b, left(word, a), right(word, b))"))


def near_words(words: DataFrame, group_max: int | None = None) -> DataFrame:
    """(word, n_near long, best_n long, best string) of the words that have near ones: how many, and the one of largest n (ties: the
    smallest in code-point order). `words` (word, n) are distinct.

    A word of L characters is asked for under its two halves, and stands for words of L - 1, L and L + 1 under theirs. Groups of one exact half are
    counted, and those of more than `group_max` words cut the half with the error again; a group whose error has one place holds a word of each
    character at most. Groups go to buckets of about BUCKET_ROWS rows, each searched by one task; only counts and best words leave it.
    """
    group_max = group_max or GROUP_MAX
    scratch = Scratch(words.sparkSession, "variants")
    base = words.withColumn("len", F.char_length("word")).withColumn("ql", F.explode(F.expr("array(len - 1, len, len + 1)"))).where("ql > 0")

    def halved(rows: DataFrame) -> DataFrame:
        # the error is in the second half of what is left open, or in the first
        mid = "a + (ql - b - a) div 2"
        return _exact(rows.selectExpr("word", "n", "len", "ql", f"inline(array(named_struct('a', cast({mid} as int), 'b', b), named_struct('a', a, 'b', cast(ql - ({mid}) as int))))").where("len >= a + b"))

    todo, done = scratch.save(halved(base.selectExpr("*", "0 as a", "0 as b"))), []
    while True:
        # groups without a query or with one word only have no pairs
        size = todo.groupBy("k").agg(F.count("*").alias("rows"), F.max((F.col("len") == F.col("ql")).cast("int")).alias("asked"), F.first(F.col("ql") - F.col("a") - F.col("b")).alias("open"))
        size = scratch.save(size.where("rows > 1 and asked = 1").selectExpr("k", f"rows > {int(group_max)} and open > 1 as hot"), slim=True)
        todo = todo.join(size, "k")
        done.append(todo.where("not hot").drop("hot"))
        if not size.where("hot").limit(1).count():
            break
        todo = scratch.save(halved(todo.where("hot").drop("hot", "k")))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    rows = scratch.save(rows.drop("len"))
    buckets = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(pdf["word"], pdf["n"], strict=True))
        out = []
        for backward in (False, True):
            side = pdf[(pdf["a"] < pdf["b"]) == backward]
            if not len(side):
                continue
            turn = (lambda w: w[::-1]) if backward else (lambda w: w)
            listed = sorted(map(turn, set(side["word"])))
            automaton = Automaton(listed)
            for w, ql, a, b in zip(side["word"], side["ql"], side["a"], side["b"], strict=True):
                if len(w) != ql:
                    continue
                at = (b, ql - a) if backward else (a, ql - b)
                got = [turn(listed[i]) for i in automaton.near(turn(w), *at)]
                if b:  # such a word is found where the error is to the right
                    got = [x for x in got if not x.startswith(w[: ql - b])]
                if got:
                    best = min(got, key=lambda x: (-known[x], x))
                    out.append((w, len(got), known[best], best))
        return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])

    found = rows.withColumn("bucket", F.pmod(F.hash("k"), F.lit(buckets))).groupBy("bucket").applyInPandas(lambda pdf: search(pdf), "word string, n_near long, best_n long, best string")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("x"))
    return found.select("word", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.best").alias("best"))


def roots(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: the last of the chain. Each round doubles the steps taken; a form occurs twice as often at least, so
    chains are short and have no cycles."""
    cur = scratch.save(words.where("form is not null").select("word", F.col("form").alias("root")), slim=True)
    while True:
        on = cur.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        nxt = scratch.save(cur.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), slim=True)
        scratch.drop(cur)
        cur = nxt
        if not cur.where("moved").limit(1).count():
            return cur.select("word", "root")


def group(words: DataFrame, min_ratio: int = 2) -> DataFrame:
    """(word, form, root string; n, n_near, form_n long): distinct words (word, n) with their form, the near word of largest n (ties: the smallest in
    code-point order) if that is at least `min_ratio` times the word's, and the last form of the chain."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words, slim=True)
    x = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= min_ratio * F.col("n")
    x = scratch.save(x.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), slim=True)
    return x.join(roots(x, scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_n: int = 3, slip: int = 97) -> DataFrame:
    """(word, form, root string; n, n_near, form_n long): `group` of the words (`word_counts`) that occur `min_n` times or more in all texts.

    Defined cases: null and empty texts have no words; a null id is an empty string before the colon; repeated rows count each; words of any
    length are words; form and form_n are null where no near word occurs often enough, and root is the word itself then. An empty table gives an empty
    result; other columns are not read, whatever their names.
    """
    return group(word_counts(docs, id_col, text_col, min_chars, slip).where(F.col("n") >= min_n))
