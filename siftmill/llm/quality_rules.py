"""Quality rules as a bitmask ledger.

`ledger` measures every text once and stores, per document, the measurements and one long whose bit r is
set where rule r failed. Policies are versioned masks over those bits: applying one, or finding what each
of its rules costs, reads the ledger only, never a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_alpha_words long, n_upper long, n_letters long"


def measure(data: bytes) -> tuple[int, ...]:
    """All measurements of one text, in the order of MEASURES; `b""` measures as zeros."""
    buf = bt.as_array(data)
    if not len(buf):
        return (0,) * 9
    s, e = bt.word_spans(buf)
    n = len(s)
    is_space = bt.SPACE[buf]
    word_chars = int(np.count_nonzero(~is_space & ((buf & 0xC0) != 0x80)))
    n_symbols = int(np.count_nonzero(_SYMBOL[buf]))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n >= 3:
        h = bt.combine(bt.span_hashes(buf, s, e), 3)
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[inverse] > 1)
        covered = np.zeros(n, bool)
        for j in range(3):
            covered[again + j] = True
        repeat = int(covered.sum())
    lower, upper = (buf >= 97) & (buf <= 122), (buf >= 65) & (buf <= 90)
    letter = lower | upper | (buf >= 0x80)
    per_word = np.concatenate(([0], np.cumsum(letter)))
    alpha_words = int(np.count_nonzero(per_word[e] > per_word[s])) if n else 0
    return n, word_chars, n_symbols, lines, dup, repeat, alpha_words, int(upper.sum()), int((lower | upper).sum())


@dataclass(frozen=True)
class Rule:
    """`failed` is a condition over the measurements; null conditions count as not failed."""

    bit: int
    name: str
    failed: Callable[[], Column]


#: A rule keeps its bit for ever; new rules take new bits.
RULES = [
    Rule(0, "too_few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule(2, "short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule(3, "long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
    Rule(4, "many_symbols", lambda: 100 * F.col("n_symbols") > 20 * F.col("n_words")),
    Rule(5, "duplicate_lines", lambda: (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 50 * F.col("n_lines"))),
    Rule(6, "few_letters", lambda: 100 * F.col("n_alpha_words") < 60 * F.col("n_words")),
    Rule(7, "capitals", lambda: 100 * F.col("n_upper") > 60 * F.col("n_letters")),
]
BASE = 0b11
POLICIES = {1: BASE, 2: 0b01111111, 3: 0b11111111}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(id, measurements..., fail_bits long): one row per input row, every rule evaluated.

    A null or empty text has all measurements 0 and so fails `too_few_words`. Repeated rows and repeated or
    null ids keep one ledger row each. Other columns of `docs` are not read, whatever their names. An empty
    table gives an empty ledger. Texts of any length are measured whole; hashing works in blocks.
    """
    bt.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out_type = f"id {src.schema['id'].dataType.simpleString()}, {MEASURES}"
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t or b"") for t in bt.texts(b.column("text"))], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(rows[:, i]) for i in range(len(names)))], ["id", *names])

    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.failed(), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return src.mapInArrow(bt.tidied(run), out_type).withColumn("fail_bits", bits).withColumnRenamed("id", id_col)


def apply_policy(led: DataFrame, version: int, policies: dict[int, int] = POLICIES) -> DataFrame:
    """Adds kept boolean: no bit of the policy's mask is set."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policies[version]).cast("long")) == 0)


def ablate(led: DataFrame, version: int, policies: dict[int, int] = POLICIES, rules: list[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: rows that fail it, fail it alone, and would be kept without it.

    Rows are first reduced to counts by bit pattern (at most 2**rules rows), partially before the shuffle.
    """
    mask = policies[version]
    patterns = led.select(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    parts = None
    for r in rules:
        if not mask >> r.bit & 1:
            continue
        bit, rest = F.lit(1 << r.bit).cast("long"), F.lit(mask & ~(1 << r.bit)).cast("long")
        hit, others = F.col("p").bitwiseAND(bit) != 0, F.col("p").bitwiseAND(rest) != 0
        one = patterns.agg(
            F.lit(version).alias("version"), F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"),
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(hit & ~others, F.col("n"))), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.sum(F.when(~others, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts
