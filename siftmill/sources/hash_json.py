"""Hash files: three generations of JSON, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.functions.titles import hash_in_name

# Keys of the flat format that are not URIs, and what names of hash files hold.
SPECIAL_KEYS = ("_hash_params", "dry_run", "input_paths")
NAME_PATTERN = r"(?i)(hash|collection|global)[^/]*\.json$"
_MAP = "map<string,string>"


def hash_entries(text: Column) -> Column:
    """array<struct<uri, hash, size, params>> of a hash file's text.

    `hashes` (of structs or strings), else `results`, else `files`, else the flat form without its special keys. A hash may also stand in
    the name, as `[hash-...]`. Text that is not JSON gives null.
    """
    def entries(top: Column) -> Column:
        inner = F.coalesce(*[F.from_json(top[k], _MAP) for k in ("hashes", "results", "files")], top)
        pairs = F.filter(F.map_entries(inner), lambda e: ~e["key"].isin(*SPECIAL_KEYS))

        def one(e: Column) -> Column:
            is_struct = e["value"].startswith("{")
            h = F.when(is_struct, F.get_json_object(e["value"], "$.hash")).otherwise(e["value"])
            return F.struct(
                e["key"].alias("uri"), F.coalesce(F.when(h != "", h), hash_in_name(e["key"])).alias("hash"),
                F.when(is_struct, F.get_json_object(e["value"], "$.size").try_cast("int")).alias("size"), top["_hash_params"].alias("params"),
            )

        return F.filter(F.transform(pairs, one), lambda x: x["hash"].isNotNull())

    # the file is parsed once, and once more within
    return F.transform(F.array(F.from_json(text, _MAP)), entries)[0]


def read_hash_files(spark: SparkSession, path: str, name_pattern: str | None = None) -> DataFrame:
    """(file, uri, hash, size, params) of all entries in the files under `path`; each file is one JSON value."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    if name_pattern:
        files = files.where(F.col("file").rlike(name_pattern))
    return files.select("file", F.explode(hash_entries(F.col("value"))).alias("e")).select("file", "e.*")


def merge_files(entries: DataFrame, order: str = "file") -> DataFrame:
    """One row per URI: files that come later in `order` win."""
    return entries.groupBy("uri").agg(F.max(F.struct(order, "hash", "size", "params")).alias("m")).select("uri", "m.hash", "m.size", F.col(f"m.{order}").alias("file"))


def usable(entries: DataFrame, min_digits: int = 8) -> DataFrame:
    return entries.withColumn("hash", F.lower("hash")).where(F.length("hash") >= min_digits)


def validate(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_entries, valid) of each file."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    n = F.coalesce(F.size(hash_entries(F.col("value"))), F.lit(0))
    return files.select(F.col("_metadata.file_path").alias("file"), n.alias("n_entries"), (n > 0).alias("valid"))


def latest_pointer(spark: SparkSession, path: str) -> DataFrame:
    """(path): the last line that is not blank of a pointer list."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("l"))
    return lines.where(F.size("l") > 0).select(F.trim(F.element_at("l", -1)).alias("path"))


def _by_uri(entries: Column) -> Column:
    return F.array_sort(entries, lambda a, b: F.when(a["uri"] < b["uri"], -1).when(a["uri"] > b["uri"], 1).otherwise(0))


def hash_json(catalog: DataFrame, new_format: bool = True, params: str = "hash_size=10;hash_version=1") -> DataFrame:
    """(value): one JSON text of the whole catalog, which a file of this format is by definition; for per-folder exports.

    Metadata keys overwrite base keys of an entry.
    """
    base = F.struct(F.col("hash_value").alias("hash"), F.col("hash_size").alias("size"), F.col("calculated_time").alias("timestamp"), F.col("file_size"))
    entry = F.map_concat(F.map_filter(F.from_json(F.to_json(base), _MAP), lambda k, v: ~F.coalesce(F.map_contains_key(F.from_json(F.col("metadata"), _MAP), k), F.lit(False))), F.coalesce(F.from_json(F.col("metadata"), _MAP), F.create_map().cast(_MAP)))
    if not new_format:
        entry = F.map_filter(entry, lambda k, v: k.isin("hash", "size"))
    m = F.map_from_entries(_by_uri(F.collect_list(F.struct(F.col("uri"), entry.alias("e")))))
    one = catalog.agg(m.alias("m"))
    if new_format:
        return one.select(F.to_json(F.struct(F.lit(params).alias("_hash_params"), F.col("m").alias("hashes"))).alias("value"))
    return one.select(F.to_json("m").alias("value"))


def write_hash_json(catalog: DataFrame, path: str, new_format: bool = True, by: str | None = None) -> None:
    """Writes `hash_json` as text; with `by`, one file per value of that column, in a folder of its own."""
    if by is None:
        hash_json(catalog, new_format).coalesce(1).write.mode("overwrite").text(path)
        return
    entry = F.struct(F.col("hash_value").alias("hash"), F.col("hash_size").alias("size"))
    m = catalog.groupBy(by).agg(F.map_from_entries(_by_uri(F.collect_list(F.struct(F.col("uri"), entry.alias("e"))))).alias("hashes"))
    m.select(by, F.to_json(F.struct("hashes")).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def migrate(spark: SparkSession, path: str, calculated_time: float) -> tuple[DataFrame, DataFrame]:
    """(catalog rows, log rows) of the hash files under `path`."""
    from siftmill.operators.catalog import records

    e = read_hash_files(spark, path)
    rows = records(merge_files(e).select("uri", F.col("hash").alias("hash_value"), F.col("size").alias("hash_size"), F.lit(calculated_time).alias("calculated_time")))
    log = e.groupBy(F.col("file").alias("source_file")).agg(F.count("*").alias("migrated_count")).withColumn("migration_time", F.timestamp_seconds(F.lit(calculated_time))).withColumn("status", F.lit("completed"))
    return rows, log


def pointer_row(catalog_path: str, pointer_rows: DataFrame) -> DataFrame:
    """The pointer list with one line more."""
    spark = pointer_rows.sparkSession
    n = F.coalesce(F.max("line_no").over(Window.partitionBy()), F.lit(0))
    return pointer_rows.unionByName(spark.range(1).select(F.lit(catalog_path).alias("path"), F.lit(None).cast("long").alias("line_no"))).withColumn("line_no", F.coalesce("line_no", n + 1))
