"""A corpus pipeline of five of the llm operators: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import byte_bpe, jaccard, mixing, qda, suffix_dedup
from siftmill.llm.queries import MIX_WEIGHTS, domain, held_out, read, tokenizer_path
from siftmill.plans.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, fitted on the labelled ones outside the held-out fold, predicts to be good.

    Null texts are scored as empty ones; a score of exactly 0.5 stays; repeated rows are judged alike; with labels of one class only, the
    share of label 1 decides for all. An empty table stays empty; all columns are carried as they are.
    """
    features = Scratch(spark, "quality").save(qda.featurise(docs))
    model = qda.fit(features.where(~held_out()), read(spark, sf_dir, "labels"))
    return qda.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near duplicates.

    Null, empty and wordless texts are near nothing and stay, as do null ids; rows that repeat an id stay or go together. An
    empty table stays empty; all columns are carried as they are.
    """
    gone = jaccard.join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 400 bytes that occur again. Bytes of characters that a cut splits go too.

    Null texts become empty; repeated rows lose what they share, which is all of a text of 400 bytes or more; no row goes. `n_chars`, if
    there, is counted anew. An empty table stays empty; other columns are carried as they are, whatever their names.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = suffix_dedup.Repeats(docs, min_len=400).cut(with_text=True, carry=tuple(carried))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col("c")[c] for c in carried}
    if "n_chars" in new:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return done.select(*[new[c].alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, as often as their epochs take them.

    Null languages and sources are leaves of their own; null and empty texts have no tokens and come along when their turn is before the
    budget; ties in the seeded order go by id, tokens and text. An empty table stays empty; all columns are carried as they are.
    """
    columns = docs.columns
    got = mixing.mix(docs, None, MIX_WEIGHTS, domain(), max_epochs=3, carry=tuple(c for c in columns if c != "doc_id"))
    return got.select("doc_id", *[F.col(f"c_{c}").alias(c) for c in columns if c != "doc_id"]).select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document of the mixture. A null or empty text has no ids; repeated rows are encoded each; an empty
    table gives an empty result; other columns are not read."""
    ids = byte_bpe.encode(docs, *tokenizer_path(), offsets=False)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]

#: SQL has no byte-pair encoding, discriminant or epoch selection; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to `documents`; every result but the last is written once, as later stages read it several times."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.release()
    return STAGES[-1][1](spark, docs, sf_dir)
