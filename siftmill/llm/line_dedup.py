"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A run is a written table of (h, owner): the hashes of lines first met in one batch of documents, in buckets by hash and sorted within
them, with the id of the document that holds each. Runs share no hash. A new batch anti-joins the runs, bucket by bucket without
shuffling them, and what is left becomes a run of its own; `fanout` runs of a level are compacted into one run of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, NumericType, StringType

from siftmill.plans.scratch import Scratch

BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. `lower` does no more than that to a text of ASCII alone, and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _rank(col: Column, kind) -> Column:
    """A number that does not fall as ids rise: of strings, their first six bytes."""
    if isinstance(kind, NumericType):
        return col.cast("double")
    if isinstance(kind, (StringType, BinaryType)):
        return F.conv(F.rpad(F.substring(F.hex(col), 1, 12), 12, "0"), 16, 10).cast("double")
    return col.cast("timestamp").cast("double")


class LineRuns:
    """Hashes of all lines met so far, as levels of sorted runs. `add` takes batches in the order of their ids."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self._scratch = Scratch(spark, "line-runs")
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """The rows of `lines` (h binary, id, ...) that are copies: their hash is in a run, or in a smaller id of the batch. Adds the batch's run.

        Null ids count as one document after all others; a hash that occurs again in its owner is no copy.
        """
        fresh = lines.groupBy("h").agg(F.min("id").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(run.select("h"), "h", "left_anti")
        fresh = self._scratch.save_by(fresh, "h", self._buckets, sort=True)
        self._put(fresh, 0)
        first = fresh.select(F.col("h").alias("_h"), "owner")
        return lines.join(first, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("owner")), "left_anti")

    def compact(self) -> None:
        """Merges every level that has `fanout` runs into one run of the next. Results of `add` must be written before."""
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = level[0]
                for run in level[1:]:
                    merged = merged.unionByName(run)
                self._put(self._scratch.save_by(merged, "h", self._buckets, sort=True), k + 1)
                self._scratch.drop(*level)
                level.clear()

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, row long, pos int, h binary): the lines whose key has `min_chars` code points or more.

    A key is a line without blanks at both ends, A-Z in lower case; h is its MD5. `row` tells texts of one id apart; pos counts from 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(_lines(lower_ascii(text))).alias("pos", "line"))
    x = x.withColumn("key", F.btrim("line", F.lit(BLANK))).where(F.char_length("key") >= min_chars)
    return x.select("id", "row", "pos", F.unhex(F.md5("key")).alias("h"))


def drop_lines(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines long, n_dropped long, kept string): every row of `docs` without the lines at `drops` (id, row, pos).

    What lies between dropped lines is taken as slices, so that work follows a text's lines and not their square.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("row"))
    at = drops.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.array_sort(F.collect_set("pos")).alias("at"))
    x = src.join(at, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")

    def kept(v: Column) -> Column:
        ends = F.concat(v["at"], F.array(F.size(v["lines"])))
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(v["at"], i - 1) + 1)
        return F.array_join(F.flatten(F.transform(ends, lambda end, i: F.slice(v["lines"], begin(i) + 1, end - begin(i)))), "\n")

    # bound once: lambdas would split the text anew for each element
    bound = F.transform(F.array(F.struct(_lines(F.col("text")).alias("lines"), F.col("at").alias("at"))), kept)[0]
    n_lines = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return x.select(
        F.col("id").alias(id_col), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("at").isNull(), F.col("text")).otherwise(bound).alias("kept"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 6, fanout: int = 3) -> DataFrame:
    """(id, n_lines long, n_dropped long, kept string): keys of at least `min_chars` code points that two documents hold lose all their lines but
    those in the document of smallest id.

    Documents come in `batches` ranges of ids, smallest first, so a run's owner is the smallest id of all. Ranges are approximate
    quantiles; where they lie changes no result.

    Defined cases: a null text is empty, one empty line; null ids count as one document after all others; rows that repeat an id are one
    document, and each gets a row; shorter keys, blank lines among them, are never dropped; a text that loses all lines is empty. An empty table
    gives an empty result; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    rank = _rank(F.col("id"), docs.schema[id_col].dataType)
    bounds = docs.select(F.col(id_col).alias("id")).agg(F.percentile_approx(rank, [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    bounds = sorted(set(bounds or []))
    # ids without a rank, nulls, come last
    batch = F.lit(0)
    for b in bounds:
        batch = batch + F.when(rank <= b, 0).otherwise(1)
    lines = scratch.save(line_hashes(docs, id_col, text_col, min_chars).withColumn("batch", batch), parts="batch")
    runs = LineRuns(spark, fanout)
    drops = None
    for k in range(len(bounds) + 1):
        found = scratch.save(runs.add(lines.where(F.col("batch") == k).drop("batch")).select("id", "row", "pos"), slim=True)
        runs.compact()
        drops = found if drops is None else drops.unionByName(found)
    return drop_lines(docs, drops, id_col, text_col)
