"""Written intermediate tables: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a temporary one where that is unset and Spark runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own_root
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="siftmill-")
        atexit.register(shutil.rmtree, _own_root, True)
    return f"file://{_own_root}"


class Scratch:
    """Tables of one operator run, each written once as Parquet under the shared folder.

    `save` returns a DataFrame that reads the written copy, so later stages never recompute what came
    before; `save_by` one whose copy is bucketed by a column, so that joins on it do not shuffle it again. `drop` removes
    copies that are not needed any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        #: The frames themselves are kept beside their paths: an id is unique only while its object lives.
        self._kept: dict[int, tuple[DataFrame, str]] = {}

    def _next(self) -> str:
        self._n += 1
        if self._n == 1:
            fs, base = self._fs(self.base)
            fs.mkdirs(base)
            fs.deleteOnExit(base)  # results may read these tables until the application ends
        return f"{self.base}/t{self._n}"

    def save(self, df: DataFrame, slim: bool = False, parts: str | None = None) -> DataFrame:
        """A written copy. `slim` is for tables of a few narrow columns that no Python makes: they go to as few files as their size asks for.
        With `parts`, the last column, rows of one value of it lie in a folder of their own, and a filter on it reads that folder only."""
        path, key = self._next(), "spark.sql.adaptive.coalescePartitions.parallelismFirst"
        before = self.spark.conf.get(key)
        try:
            if slim:
                self.spark.conf.set(key, "false")
            w = self._writer(df)
            (w.partitionBy(parts) if parts else w).parquet(path)
        finally:
            if slim:
                self.spark.conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._kept[id(out)] = (out, path)
        return out

    def _writer(self, df: DataFrame):
        # each file costs something on most stores, on local ones a process to set its mode; nobody looks for this one
        return df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")

    def save_by(self, df: DataFrame, column: str, buckets: int | None = None, sort: bool = False) -> DataFrame:
        """A copy in `buckets` files (the session's shuffle partitions) by hash of `column`, each in its order with `sort`.

        Buckets are known to the catalog only, so the copy is a table there for a moment: the frame keeps what it needs of it.
        """
        path, n = self._next(), buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = "siftmill_" + path.rsplit("/", 2)[1].replace("-", "_") + f"_t{self._n}"
        w = self._writer(df.repartition(n, column)).format("parquet").bucketBy(n, column)
        (w.sortBy(column) if sort else w).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out.schema  # noqa: B018  resolved while the name is there
        self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
        self._kept[id(out)] = (out, path)
        return out

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished stages: it does so once their plans are garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            _, path = self._kept.pop(id(f), (None, None))
            if path:
                fs, p = self._fs(path)
                fs.delete(p, True)
