"""Ids that very many rows share, buckets that follow the data, offsets that are not asked for."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("siftmill.llm")
from siftmill.llm import byte_bpe, jaccard, mixing  # noqa: E402


@pytest.mark.parametrize("total", [None, 9000])
def test_mixing_of_ids_that_many_rows_share(spark, total, monkeypatch):
    monkeypatch.setattr(mixing, "CROWDED", 2)
    rnd = random.Random(3)
    ids = [None] * 700 + [7] * 500 + [8] * 100 + list(range(100, 400))
    rows = [(i, f"text {k if k % 3 else 0} " + "word " * rnd.randrange(9), "en" if k % 5 else None, "s1") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    run = lambda n: mixing.mix(docs, total, {}, F.lit("d"), max_epochs=2, rows_per_bucket=n, carry=("text",))
    few, all_at_once = ([(r.doc_id, r.lang, r.epoch, r.start, r.tokens, r.c_text) for r in run(n).collect()] for n in (20, 10**9))
    key = lambda r: tuple(map(str, r))
    assert sorted(few, key=key) == sorted(all_at_once, key=key)
    # starts follow each other without gaps within a leaf and epoch
    for leaf in {(r[1], r[2]) for r in few}:
        at = None
        for _, _, _, start, tok, _ in sorted((r for r in few if (r[1], r[2]) == leaf), key=lambda r: (r[3], r[4])):
            assert at is None or start == at
            at = start + tok


def test_a_third_of_all_rows_without_an_id_is_cut(spark):
    n = 100_000
    docs = spark.range(n).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    got = mixing.mix(docs, None, {}, F.lit("d"), max_epochs=1, rows_per_bucket=500)
    assert got.agg(F.count("*"), F.count_distinct("start"), F.max("start")).first()[:2] == (n, n)


def test_buckets_follow_the_postings(spark, monkeypatch):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(30)) for _ in range(rnd.randrange(4, 60))) for _ in range(40)]
    rows = [(k, t if k < 40 else " ".join(t.split()[:-1])) for k, t in enumerate(base + base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, jaccard.join(docs).collect()))
    monkeypatch.setattr(jaccard, "BUCKET_POSTINGS", 7)
    assert sorted(map(tuple, jaccard.join(docs).collect())) == want
    sizes = {1: 5, 10: 2, 100: 3}
    small = lambda n: jaccard.prefix_length(n, 2) * (jaccard.prefix_length(n, 2) - 1) // 2
    assert jaccard.postings(sizes, 10) == 5 * small(1) + 2 * (small(10) + jaccard.prefix_length(10, 1)) + 3 * jaccard.prefix_length(100, 1)


def test_ids_without_offsets(spark):
    public = pytest.importorskip("public_tokenizers")
    at = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    docs = spark.createDataFrame([(1, "some text é"), (2, None), (3, "")], "doc_id long, text string")
    plain, full = byte_bpe.encode(docs, *at, offsets=False), byte_bpe.encode(docs, *at)
    assert plain.columns == ["doc_id", "ids"] and full.columns == ["doc_id", "ids", "starts", "ends"]
    assert [tuple(r) for r in plain.collect()] == [tuple(r) for r in full.select("doc_id", "ids").collect()]
