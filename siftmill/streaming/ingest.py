"""Catalog ingest as a stream: beyond batch upserts, the same result as an append-only table and a latest view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.catalog import CATALOG, latest, records


def read_records(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def distinct_within(stream: DataFrame, time: str, delay: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows of one key once within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def append_catalog(stream: DataFrame, path: str, checkpoint: str, interval: str = "300 seconds", once: bool = False):
    """Appends catalog rows per trigger; `current` over the table is the upserted catalog. Batches are written by number, so a repeated batch does not double."""

    def write(batch: DataFrame, number: int) -> None:
        records(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """One row per URI: of the last batch, then the latest time."""
    t = spark.read.option("basePath", path).parquet(path)
    return latest(t, ("uri",), ("batch", "calculated_time")).select(*[f.name for f in CATALOG.fields])


def session_counts(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
