"""Which of many strings texts contain: Aho-Corasick automata over parts of the strings, each of a bounded size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.plans.scratch import Scratch

#: Characters of the needles of one automaton, which is what is broadcast at a time; an automaton takes about 100 bytes for each.
PART_CHARS = 1 << 20

_automata: dict[str, object] = {}


def _automaton(name: str, needles: list[str]):
    """The worker's automaton over a part; a worker keeps one at a time."""
    if name not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for n in needles:
            a.add_word(n, n)
        a.make_automaton()
        _automata.clear()
        _automata[name] = a
    return _automata[name]


def contained(items: DataFrame, needles: DataFrame, text_col: str, needle_col: str, part_chars: int | None = None) -> DataFrame:
    """Rows of `items` with each different needle that their text contains, once, as the column `needle_col`.

    Needles are divided by hash into parts of about `part_chars` characters; each part is one broadcast automaton, which reads every text
    once whatever the number of its needles. So a text is read once per part, and what a task holds does not grow with the needles.

    Defined cases: null and empty needles are in no text, null texts have none; repeated needles count once; letters are compared as they
    are; without needles the result is empty.
    """
    part_chars = part_chars or PART_CHARS
    spark = items.sparkSession
    scratch = Scratch(spark, "needles")
    n = scratch.save(needles.select(F.col(needle_col).cast("string").alias("needle")).where("needle <> ''").distinct())
    parts = max(1, -(-int(n.agg(F.sum(F.length("needle") + 1)).first()[0] or 0) // part_chars))
    n = scratch.save(n.withColumn("part", F.pmod(F.xxhash64("needle"), F.lit(parts))), parts="part")
    found = None
    for k in range(parts):
        listed = spark.sparkContext.broadcast([r.needle for r in n.where(F.col("part") == k).select("needle").collect()])
        hit = _finder(f"{scratch.base}/{k}", listed)(F.col(text_col))
        one = items.withColumn("_found", hit).where("size(_found) > 0").withColumn(needle_col, F.explode("_found")).drop("_found")
        found = one if found is None else found.unionByName(one)
    return found


def _finder(name: str, listed):
    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        a = _automaton(name, listed.value)
        if not listed.value:
            return pd.Series([[]] * len(texts), dtype=object)
        return pd.Series([sorted({w for _, w in a.iter(t)}) if t else [] for t in texts], dtype=object)

    return find
