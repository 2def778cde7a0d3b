"""Fingerprints that need an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simhash(docs: DataFrame, id_col: str = "id", text_col: str = "text", words: int = 5, bits: int = 64) -> DataFrame:
    """(id, simhash bigint): similar texts get close fingerprints, of up to 64 bits (the last is the sign).

    A fingerprint is a hint, not a measure: texts of Jaccard 0.8 differ in about 15 % of the bits. What is to hold for a
    similarity is found by `llm/jaccard.join`.

    Words are runs other than white space, lower case. Each bit is the sign of a sum over the hashes of a text's word n-grams; the
    sums are one aggregation, reduced within each task before the shuffle. Texts without a word, or null, get 0.
    """
    w = F.filter(F.split(F.lower(text_col), r"\s+"), lambda x: x != "")
    x = docs.select(F.col(id_col).alias("id"), w.alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    h = x.select("id", F.explode_outer(F.when(F.size("w") > 0, grams)).alias("h"))
    bit = lambda i: F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1)) * 2 - 1)
    sums = h.groupBy("id").agg(*[bit(i).alias(f"s{i}") for i in range(bits)])
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.coalesce(F.col(f"s{i}") > 0, F.lit(False)).cast("bigint"), i))
    return sums.select(F.col("id").alias(id_col), out.alias("simhash"))
