"""The query that groups near copies of texts, against brute force over all pairs."""

import itertools
import random

from pyspark.sql import functions as F

import __spark_entry__
from siftmill.operators import fingerprint


def test_near_copies_at_the_threshold(spark, tmp_path):
    rnd = random.Random(3)
    texts = []
    for n in (40, 104, 204, 404):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        texts.append(base)
        for cut in (n // 20, n // 10, n // 6, n // 4):  # a tail of other words: from well above 0.8 to well below
            texts.append(base[: n - cut] + [f"x{rnd.randrange(10**6)}" for _ in range(cut)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "  ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows if (w := (t or "").split())}
    root = {i: i for i, _ in rows}
    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            lo, hi = sorted((root[a], root[b]))
            root = {i: lo if r == hi else r for i, r in root.items()}
    got = {r.item_id: r.group_id for r in __spark_entry__.queries()["simhash_groups"](spark, str(tmp_path)).collect()}
    assert got == root and 4 < len(set(root.values())) < len(rows)


def test_simhash_has_64_bits_of_five_words(spark):
    text = "a b c d e f g h i"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    got = {r.id: r.simhash for r in fingerprint.simhash(df).collect()}
    w = text.split()
    grams = spark.createDataFrame([(" ".join(w[i : i + 5]),) for i in range(5)], "g string").select(F.xxhash64("g").alias("h")).collect()
    bits = sum(1 << i for i in range(64) if sum(r.h >> i & 1 for r in grams) >= 3)
    assert got == {1: bits - (1 << 64 if bits >> 63 else 0), 2: 0}
