"""The versioned hash catalog: schema, upserts, lookups and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.functions.uris import catalog_parts
from siftmill.operators.needles import contained
from siftmill.plans.scratch import Scratch

CATALOG = T.StructType(
    [
        T.StructField("uri", T.StringType(), False), T.StructField("filename", T.StringType()), T.StructField("file_extension", T.StringType()),
        T.StructField("base_uri", T.StringType()), T.StructField("archive_name", T.StringType()), T.StructField("hash_value", T.StringType(), False),
        T.StructField("hash_size", T.IntegerType()), T.StructField("hash_algorithm", T.StringType()), T.StructField("file_size", T.LongType()),
        T.StructField("image_width", T.IntegerType()), T.StructField("image_height", T.IntegerType()), T.StructField("created_time", T.DoubleType()),
        T.StructField("modified_time", T.DoubleType()), T.StructField("accessed_time", T.DoubleType()), T.StructField("calculated_time", T.DoubleType()),
        T.StructField("source_type", T.StringType()), T.StructField("metadata", T.StringType()),
    ]
)
MIGRATION_LOG = T.StructType(
    [T.StructField("source_file", T.StringType()), T.StructField("migrated_count", T.LongType()), T.StructField("migration_time", T.TimestampType()), T.StructField("status", T.StringType())]
)


def records(hashes: DataFrame, hash_size: int = 10, algorithm: str = "phash") -> DataFrame:
    """Catalog rows of (uri, hash_value, calculated_time[, any other catalog column]); what is not given is derived or null."""
    p = catalog_parts(F.col("uri"))
    x = hashes.withColumn("_p", p)
    have = set(hashes.columns)
    default = {"hash_size": F.lit(hash_size), "hash_algorithm": F.lit(algorithm), "source_type": F.col("_p.source_type")}
    default |= {c: F.col(f"_p.{c}") for c in ("filename", "file_extension", "base_uri", "archive_name")}
    out = [(F.col(f.name) if f.name in have else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in CATALOG.fields]
    return x.where("uri IS NOT NULL AND hash_value IS NOT NULL AND hash_value <> ''").select(*out)


def latest(rows: DataFrame, keys: Sequence[str] = ("uri",), order: Sequence[str] = ("calculated_time",)) -> DataFrame:
    """The last row of each key, by `order`; what an upsert leaves. Ties by all columns, so that results are stable.

    An aggregation with partial results before the shuffle, so a key with very many versions is no hot spot.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return best.select(*[c if c in keys else F.col(f"_m.{c}").alias(c) for c in rows.columns])


def upsert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The catalog after `new`: rows of `new` replace rows of their URI whatever their times; the last of a batch wins."""
    x = catalog.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return latest(x, ("uri",), ("_batch", "calculated_time")).drop("_batch")


class CatalogTable:
    """A catalog on disk, in `buckets` folders by hash of the URI: an upsert reads and writes the folders of its URIs only.

    Merged rows are written to scratch first and then replace their folders in one commit, so a run that fails before that leaves the table
    as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[f.name for f in CATALOG.fields]).withColumn("bucket", F.pmod(F.xxhash64("uri"), F.lit(self.buckets)).cast("int"))

    def _put(self, rows: DataFrame) -> None:
        # a folder's rows come from one task, so that folders do not fill with small files
        w = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        w.partitionBy("bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Writes a new table of catalog rows; the last row of a URI counts."""
        self._put(self._bucketed(latest(rows)))

    def rows(self) -> DataFrame:
        schema = T.StructType([*CATALOG.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self.rows().drop("bucket")

    def upsert(self, new: DataFrame) -> list[int]:
        """Merges catalog rows, which replace those of their URIs whatever their times; the folders that changed. No rows change nothing."""
        scratch = Scratch(self.spark, "upsert")
        new = scratch.save(self._bucketed(new))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        if touched:
            old = self.rows().where(F.col("bucket").isin(touched))
            merged = scratch.save(self._bucketed(upsert(old.drop("bucket"), new.drop("bucket"))))
            self._put(merged)
            scratch.drop(merged)
        scratch.drop(new)
        return touched


def smart_lookup(queries: DataFrame, catalog: DataFrame, uri_col: str = "uri", base_of=None) -> DataFrame:
    """(queries..., hash_value, matched_uri, match): the exact URI's hash, else the newest of its base URI, else null.

    Empty hashes count as missing. `base_of` derives the base from a URI column.
    """
    base_of = base_of or (lambda c: catalog_parts(c)["base_uri"])
    good = catalog.where("hash_value IS NOT NULL AND hash_value <> ''")
    exact = latest(good.select("uri", "hash_value", "calculated_time")).select(F.col("uri").alias("_u"), F.col("hash_value").alias("_h"))
    by_base = good.groupBy("base_uri").agg(F.max(F.struct("calculated_time", "uri", "hash_value")).alias("_m")).withColumnRenamed("base_uri", "_b")
    q = queries.withColumn("_base", base_of(F.col(uri_col)))
    j = q.join(exact, F.col(uri_col) == F.col("_u"), "left").join(by_base, F.col("_base") == F.col("_b"), "left")
    return j.select(
        *[F.col(c) for c in queries.columns],
        F.coalesce("_h", "_m.hash_value").alias("hash_value"), F.when(F.col("_h").isNotNull(), F.col("_u")).otherwise(F.col("_m.uri")).alias("matched_uri"),
        F.when(F.col("_h").isNotNull(), "exact").when(F.col("_m").isNotNull(), "base").otherwise("none").alias("match"),
    )


def tiered_lookup(queries: DataFrame, tiers: Sequence[tuple[str, DataFrame]], uri_col: str = "uri") -> DataFrame:
    """(queries..., hash_value, tier): the first tier (name, rows of uri and hash_value) that has a hash for the URI."""
    x = queries
    for name, rows in tiers:
        t = rows.where("hash_value IS NOT NULL AND hash_value <> ''").groupBy("uri").agg(F.max("hash_value").alias(f"_h_{name}"))
        x = x.join(t.withColumnRenamed("uri", f"_u_{name}"), F.col(uri_col) == F.col(f"_u_{name}"), "left")
    return x.select(
        *[F.col(c) for c in queries.columns], F.coalesce(*[F.col(f"_h_{n}") for n, _ in tiers]).alias("hash_value"),
        F.coalesce(*[F.when(F.col(f"_h_{n}").isNotNull(), F.lit(n)) for n, _ in tiers]).alias("tier"),
    )


def filename_lookup(queries: DataFrame, catalog: DataFrame, uri_col: str = "uri") -> DataFrame:
    """The newest hash of any row with the same file name; an option, as names need not be unique."""
    m = catalog.groupBy("filename").agg(F.max(F.struct("calculated_time", "uri", "hash_value")).alias("_m"))
    q = queries.withColumn("filename", catalog_parts(F.col(uri_col))["filename"])
    return q.join(m, "filename", "left").select(*queries.columns, F.col("_m.hash_value").alias("hash_value"), F.col("_m.uri").alias("matched_uri"))


def under_path(catalog: DataFrame, paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Catalog rows whose URI holds a path, with the path: URIs go through automata over the paths, each path once."""
    return contained(catalog, paths.select(F.col(path_col).alias("path")), "uri", "path")


def without_invalid(rows: DataFrame, valid: DataFrame, columns: Sequence[str] = ("uri",)) -> DataFrame:
    """Rows all of whose `columns` are among the valid URIs."""
    for c in columns:
        rows = rows.join(valid.select(F.col("uri").alias("_v")), F.col(c) == F.col("_v"), "left_semi")
    return rows


def statistics(rows: DataFrame, dimensions: Sequence[str], top: int | None = None) -> DataFrame:
    """(dimension, value, n): the total, and counts by each dimension, in one pass over the rows.

    `top`: that many values per dimension, by count, then value; nulls count in the total only.
    """
    sets = rows.select(*dimensions).groupingSets([[], *[[F.col(d)] for d in dimensions]], *dimensions)
    x = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    bits = {d: (1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - i)) for i, d in enumerate(dimensions)}
    name, value = F.lit("total"), F.lit(None).cast("string")
    for d, g in bits.items():
        name, value = F.when(F.col("_g") == g, d).otherwise(name), F.when(F.col("_g") == g, F.col(d).cast("string")).otherwise(value)
    x = x.select(name.alias("dimension"), value.alias("value"), "n").where("dimension = 'total' OR value IS NOT NULL")
    if top is None:
        return x
    w = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def integrity(rows: DataFrame, required: Sequence[str], key: str) -> DataFrame:
    """(check, n): nulls or empty values of each required column, and keys that occur more than once."""
    e = [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in required]
    one = rows.agg(*e)
    empty = one.select(F.explode(F.array(*[F.struct(F.lit(f"empty_{c}").alias("check"), F.col(c).alias("n")) for c in required])).alias("r")).select("r.*")
    dup = rows.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").agg(F.lit(f"duplicate_{key}").alias("check"), F.count("*").alias("n"))
    return empty.unionByName(dup)


def parse_mismatches(catalog: DataFrame) -> DataFrame:
    """(n_rows, n_mismatched): stored URI parts against what the URI says."""
    p = catalog_parts(F.col("uri"))
    bad = ~(F.col("filename").eqNullSafe(p["filename"]) & F.col("base_uri").eqNullSafe(p["base_uri"]) & F.col("source_type").eqNullSafe(p["source_type"]))
    return catalog.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_mismatched"))


def random_rows(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows in the order of the MD5 of seed/key: a sample that is the same in every run."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
