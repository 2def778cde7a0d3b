"""Merkle fixity audit of WARC replicas.

Records are hashed; hashes of one range of offsets make a leaf; FANOUT nodes make a node, up to a root per
file. Two replicas are compared from their roots down, and only nodes that differ are opened, so the
records that reach the last comparison are those of damaged ranges.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt
from siftmill.plans.scratch import Scratch

FANOUT_BITS = 4


def record_bytes(url: Column, record_id: Column, body: Column) -> Column:
    """A WARC/1.0 response record as binary; nulls count as empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), text(url), F.lit("\r\nWARC-Record-ID: <urn:page:"), text(record_id),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text(body)).cast("string"), F.lit("\r\n\r\n"), text(body), F.lit("\r\n\r\n"),
    ).cast("binary")


def _plain(data: bytes) -> tuple[bytes, str | None]:
    """(bytes of all gzip members as far as they can be read, what is wrong with them)."""
    out, rest = [], data
    while rest:
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(rest))
        except zlib.error as e:
            return b"".join(out), f"gzip: {e}"
        if not member.eof:
            return b"".join(out), "gzip: cut off"
        rest = member.unused_data
    return b"".join(out), None


def parse(data: bytes, strict: bool = True) -> Iterator[tuple[int, int, dict[str, str], bytes, str | None]]:
    """(offset, length, headers, content, error) of each record of a WARC file, plain or gzipped (then offsets are those of the plain bytes).

    Where bytes are no whole record, `strict` raises ValueError; else they are a record with an `error`, which ends where the next record seems to start.
    """
    broken = None
    if data[:2] == b"\x1f\x8b":
        data, broken = _plain(data)
    f, at = io.BytesIO(data), 0
    while at < len(data):
        f.seek(at)
        headers: dict[str, str] = {}
        body, end, error = b"", len(data), None
        if not f.readline().startswith(b"WARC/"):
            error = "no WARC record"
        else:
            for line in iter(f.readline, b"\r\n"):
                if not line:
                    error = "the header is cut off"
                    break
                k, _, v = line.decode("utf-8", "replace").partition(":")
                headers[k.strip().lower()] = v.strip()
        if not error:
            size = headers.get("content-length", "0")
            if not size.isdigit():
                error = "no content length"
            else:
                body = f.read(int(size))
                end = f.tell() + 4
                if end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
                    error = "cut off" if end > len(data) else "the content length is wrong"
        if error:
            if strict:
                raise ValueError(f"{error} at {at}")
            following = data.find(b"\r\n\r\nWARC/", at)
            end = following + 4 if following >= 0 else len(data)
            body = data[at:end]
        yield at, end - at, headers, body, error
        at = end
    if broken:
        if strict:
            raise ValueError(broken)
        yield len(data), 0, {}, b"", broken


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset long, length long, url, content binary, error) of all records in the WARC files under `path`.

    A file is one task's input and must fit into a row (2 GB), so archives are kept in files of about 1 GB, as WARC writers do. Damaged
    or cut records, and gzip members that cannot be read, are rows with `error` set; the rows around them are whole. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "length", "url", "content", "error"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for b in batches:
            for name, data in zip(b.column("path"), b.column("content"), strict=True):
                rows, size = [], 0
                for at, n, head, body, error in parse(data.as_py(), strict=False):
                    rows.append((name.as_py().rsplit("/", 1)[-1], at, n, head.get("warc-target-uri"), body, error))
                    size += n
                    if len(rows) == 500 or size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(bt.tidied(run), "file string, offset long, length long, url string, content binary, error string")


def measured(data: Column) -> tuple[Column, Column]:
    """(length long, hash) of a record's bytes (null: empty): SHA-256 over a zero byte and the record."""
    data = F.coalesce(data.cast("binary"), F.lit(b""))
    return F.octet_length(data).cast("long").alias("length"), F.sha2(F.concat(F.lit(b"\x00"), data), 256).alias("hash")


def placed(records: DataFrame, file_col: str = "file", order_col: str = "id") -> DataFrame:
    """(file, order, offset long, others...): where each of `records` (with a `length`) starts when a file holds its records in the order of `order_col`.

    Only lengths are summed, a file at a time; records at one place in the order stand in no certain order.
    """
    w = Window.partitionBy(file_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))


def hashed(records: DataFrame, file_col: str = "file", offset_col: str = "offset", data_col: str = "record") -> DataFrame:
    """(file, offset, length, hash): leaf hashes are SHA-256 over a zero byte and the record (null: empty)."""
    return records.select(F.col(file_col).cast("string").alias("file"), F.col(offset_col).cast("long").alias("offset"), *measured(F.col(data_col)))


def _node(children: Column) -> Column:
    """Hash of a sorted array of structs, positions included, after a one byte: never mistaken for a record's."""
    return F.sha2(F.concat(F.lit("\x01"), F.to_json(children)), 256)


def tree(records: DataFrame, range_bytes: int = 1 << 20, levels: int | None = None) -> list[DataFrame]:
    """[leaves, ..., roots], each (file, idx long, hash), of `hashed` records; a leaf covers `range_bytes` of offsets.

    Children of a node are collected: at most 2**FANOUT_BITS nodes, or the records that start in one range.
    """
    leaf = records.withColumn("idx", F.floor(F.col("offset") / range_bytes))
    out = [leaf.groupBy("file", "idx").agg(_node(F.array_sort(F.collect_list(F.struct("offset", "length", "hash")))).alias("hash"))]
    while len(out) <= (levels or 1):
        up = out[-1].groupBy("file", F.shiftright("idx", FANOUT_BITS).alias("up"))
        out.append(up.agg(_node(F.array_sort(F.collect_list(F.struct("idx", "hash")))).alias("hash")).withColumnRenamed("up", "idx"))
    return out


def audit(replica_a: DataFrame, replica_b: DataFrame, range_bytes: int = 1 << 20) -> DataFrame:
    """(file, offset, length_a, hash_a, length_b, hash_b, status): one row per record that differs between replicas.

    Both inputs are (file, offset, length, hash), as from `hashed`. status is `differs`, `missing_in_a`, `missing_in_b` or, for
    rows whose file or offset is null (they have no place to be compared at), `unplaced`. Several records at
    one place are compared as a sorted list. Two empty replicas, or equal ones, give no rows.
    """
    spark = replica_a.sparkSession
    scratch = Scratch(spark, "fixity")
    cols = ["file", "offset", "length", "hash"]
    a, b = (scratch.save(x.select(*cols), slim=True) for x in (replica_a, replica_b))
    at = F.col("file").isNotNull() & F.col("offset").isNotNull()
    top = a.unionByName(b).where(at).agg(F.max("offset").alias("m")).first().m
    n, levels = (top or 0) // range_bytes, 1
    while n >> (FANOUT_BITS * levels):
        levels += 1
    ta, tb = ([scratch.save(t, slim=True) for t in tree(x.where(at), range_bytes, levels)] for x in (a, b))

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(F.col("file").alias("f2"), F.col("idx").alias("i2"), F.col("hash").alias("h2"))
        j = x.join(y, (F.col("file") == F.col("f2")) & (F.col("idx") == F.col("i2")), "full_outer")
        return j.where(~F.col("hash").eqNullSafe(F.col("h2"))).select(F.coalesce("file", "f2").alias("file"), F.coalesce("idx", "i2").alias("idx"))

    bad = scratch.save(differing(ta[-1], tb[-1]), slim=True)
    for level in range(levels - 1, -1, -1):
        parent = bad.select(F.col("file").alias("pf"), F.col("idx").alias("pi"))
        opened = lambda t: t.join(parent, (F.col("file") == F.col("pf")) & (F.shiftright("idx", FANOUT_BITS) == F.col("pi")), "left_semi")  # noqa: B023, E731
        bad = scratch.save(differing(opened(ta[level]), opened(tb[level])), slim=True)  # written: both sides of the next level read it
    parent = bad.select(F.col("file").alias("pf"), F.col("idx").alias("pi"))

    def suspects(x: DataFrame, side: str) -> DataFrame:
        s = x.where(at).join(parent, (F.col("file") == F.col("pf")) & (F.floor(F.col("offset") / range_bytes) == F.col("pi")), "left_semi")
        s = s.groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("length", "hash"))).alias("all"))
        return s.select("file", "offset", F.col("all")[0]["length"].alias(f"length_{side}"), F.array_join(F.col("all")["hash"], ",").alias(f"hash_{side}"))

    j = suspects(a, "a").join(suspects(b, "b"), ["file", "offset"], "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    status = F.when(F.col("hash_a").isNull(), "missing_in_a").when(F.col("hash_b").isNull(), "missing_in_b").otherwise("differs")
    out = ["file", "offset", "length_a", "hash_a", "length_b", "hash_b", "status"]
    j = j.withColumn("status", status).select(*out)
    none = F.lit(None)
    for x, side in ((a, "a"), (b, "b")):
        own = {f"length_{side}": F.col("length"), f"hash_{side}": F.col("hash")}
        j = j.unionByName(x.where(~at).select("file", "offset", *[own.get(c, none.cast("long" if "length" in c else "string")).alias(c) for c in out[2:6]], F.lit("unplaced").alias("status")))
    return j
