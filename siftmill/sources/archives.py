"""Archive members as rows, read from the bytes of ZIP files, archives made of rows, and operators on member listings."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.uris import is_image
from siftmill.sources import containers

_KINDS = [("archive", pa.string()), ("inner", pa.string()), ("file_size", pa.int64()), ("compress_size", pa.int64()), ("crc", pa.int64()), ("content", pa.binary()), ("ok", pa.bool_()), ("error", pa.string())]
MEMBERS = "archive string, inner string, file_size long, compress_size long, crc long, content binary, ok boolean, error string"
# Encodings that names in archives without the UTF-8 flag are tried in.
NAME_ENCODINGS = ("utf-8", "cp932", "gb18030", "big5", "euc-kr")


# Characters that names and texts in each encoding use most.
COMMON = {
    "cp932": "のいたんしとにるなてかっをはもでれがすまアイウカクコシスタトドナニフマラリルレロン人日本大年一月中出上巻話",
    "gb18030": "的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可里后么小第卷话",
    "big5": "的一是不了在人有我他這中大來上國個到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可裡後麼小第卷話",
    "euc-kr": "이다의는가을에고하지한기로사은리도서어나자인시를아정그만일대라보해수있상과부전제주장화권집",
}


def _plausible(text: str, encoding: str) -> float:
    """How much the characters beyond ASCII look like text of the encoding's language, on average; from -2 to 3."""
    marks = [c for c in text if ord(c) > 127]
    total = 0.0
    for c in marks:
        pair = c.encode(encoding, "replace")
        lead = pair[0] if len(pair) == 2 else 0
        if c in COMMON[encoding]:
            total += 3
        elif encoding == "cp932":
            total += 1 if "\u3040" <= c <= "\u30ff" or 0x88 <= lead <= 0x97 else 0 if 0x81 <= lead <= 0x83 else -2
        elif encoding == "gb18030":
            total += 1 if 0xB0 <= lead <= 0xD7 else 0 if 0xA1 <= lead <= 0xA3 else -2
        elif encoding == "big5":
            total += 1 if 0xA4 <= lead <= 0xC6 else 0 if 0xA1 <= lead <= 0xA3 else -2
        else:
            total += 1 if "\uac00" <= c <= "\ud7a3" else 0 if 0xA1 <= lead <= 0xA3 else -2
    return total / max(len(marks), 1)


def detect_encoding(names: Iterable[bytes]) -> str | None:
    """The encoding that decodes all names of an archive, and whose language their byte pairs resemble most; UTF-8 wherever it fits.

    Null if none decodes them all: then each name is decoded by itself. Names of ASCII alone say nothing.
    """
    said = [n for n in names if not n.isascii()]
    if not said:
        return None
    best: tuple[float, str] | None = None
    for e in NAME_ENCODINGS:
        try:
            text = "".join(n.decode(e) for n in said)
        except UnicodeDecodeError:
            continue
        if e == "utf-8":
            return e
        score = _plausible(text, e)
        if best is None or score > best[0]:
            best = (score, e)
    return best[1] if best else None


def decode_name(raw: bytes, encoding: str | None = None) -> str:
    """By the archive's encoding, if it is known; else the first that decodes a name and leaves less than a fifth of replacement characters; else UTF-8 with
    replacements removed."""
    for e in ([encoding] if encoding else []) + list(NAME_ENCODINGS):
        try:
            text = raw.decode(e)
        except UnicodeDecodeError:
            continue
        if text.count("\ufffd") < max(1, len(text) / 5):
            return text.replace("\ufffd", "")
    return raw.decode("utf-8", "replace").replace("\ufffd", "")


def _raw_name(info: zipfile.ZipInfo) -> bytes | None:
    """The bytes of a name that does not say its encoding."""
    return None if info.flag_bits & 0x800 or info.filename.isascii() else info.filename.encode("cp437", "replace")


def member_names(infos: Sequence[zipfile.ZipInfo]) -> list[str]:
    """Names of a ZIP file's members: all that do not say their encoding are taken to share one."""
    raw = [_raw_name(i) for i in infos]
    encoding = detect_encoding([r for r in raw if r is not None])
    return [i.filename if r is None else decode_name(r, encoding) for i, r in zip(infos, raw, strict=True)]


def _zip_members(data: bytes) -> Iterator[containers.Member]:
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    for info, name in zip(infos, member_names(infos), strict=True):
        if not info.is_dir():
            yield containers.Member(name, info.file_size, info.compress_size, info.CRC, lambda info=info: z.read(info))


def members(files: DataFrame, path_col: str = "path", content_col: str = "content", with_content: bool = False, pattern: str | None = None, test: bool = False, names_col: str | None = None) -> DataFrame:
    """One row per member of each ZIP, RAR or 7z file of a binary-file DataFrame, told apart by their first bytes; folders have no row.

    `pattern`: only members whose name matches this regular expression. `with_content`: their bytes too. `test`: `ok` says
    whether the member's checksum holds. `names_col`: an array of names, only these members of each file. A member whose method is not supported (RAR beyond stored ones, 7z beyond
    copies, LZMA, Deflate and BZip2) is listed, and its content is an error. Anything that is not a readable archive gives one row with its error.
    """
    import re

    wanted = re.compile(pattern) if pattern else None
    names = F.col(names_col) if names_col else F.lit(None).cast("array<string>")
    src = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"), names.alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _KINDS, strict=True)], [n for n, _ in _KINDS])

        for b in batches:
            for path, content, only in zip(b.column("path").to_pylist(), b.column("content"), b.column("names").to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    data = content.as_py()
                    found = list((containers.listed if containers.kind_of(data or b"") else _zip_members)(data))
                except (zipfile.BadZipFile, TypeError, NotImplementedError, ValueError) as e:
                    yield out([(path, None, None, None, None, None, False, str(e))])
                    continue
                for m in found:
                    if wanted and not wanted.search(m.name) or names_col and m.name not in (only or ()):
                        continue
                    got, ok, error = None, None, None
                    if with_content or test:
                        try:
                            got, ok = m.read(), True
                        except Exception as e:  # noqa: BLE001  a damaged member is a row that says so
                            ok, error = False, str(e)
                    rows.append((path, m.name, m.size, m.packed, m.crc, got if with_content else None, ok, error))
                    if len(rows) >= (20 if with_content else 1000):
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return src.mapInArrow(run, MEMBERS)


def pack(rows: DataFrame, archive_col: str = "archive", name_col: str = "inner", content_col: str = "content") -> DataFrame:
    """(path, content binary): a ZIP file of each archive's members, stored as they are, in the order of their names.

    A file is a row, and its members go through one task, so archives must be below 2 GB. Null contents are empty members, null archives and names
    are left out; equal members give equal bytes.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in sorted(zip(pdf["name"], pdf["content"], strict=True), key=lambda m: m[0]):
                z.writestr(zipfile.ZipInfo(name), bytes(content or b""))
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [out.getvalue()]})

    src = rows.select(F.col(archive_col).alias("path"), F.col(name_col).alias("name"), F.col(content_col).alias("content")).where("path IS NOT NULL AND name IS NOT NULL")
    return src.groupBy("path").applyInPandas(lambda pdf: one(pdf), "path string, content binary")


def scan_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """`members` of all archives (zip, cbz, rar, cbr, 7z) under a folder; paths with trash or multi folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    low = F.lower("path")
    return members(files.where(low.rlike(r"\.(?:zip|cbz|rar|cbr|7z)$") & ~low.rlike(r"/[^/]*(?:trash|multi)[^/]*/")), **options)


def image_counts(listing: DataFrame) -> DataFrame:
    return listing.groupBy("archive").agg(F.count_if(is_image(F.col("inner"))).alias("n_images"))


def excluded_archives(listing: DataFrame, formats: tuple[str, ...] = ("gif", "mp4", "webm", "mkv", "mov")) -> DataFrame:
    """(archive, excluded): whether any member has one of the formats."""
    return listing.groupBy("archive").agg(F.bool_or(F.coalesce(F.lower("inner").rlike(r"\.(?:" + "|".join(formats) + ")$"), F.lit(False))).alias("excluded"))


def merged(listings: DataFrame) -> DataFrame:
    """Members of several archives as members of one: the source archive's stem is their first folder."""
    stem = F.regexp_extract("archive", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return listings.withColumn("source_archive", F.col("archive")).withColumn("inner", F.concat(stem, F.lit("/"), "inner"))


def split_again(merged_listing: DataFrame) -> DataFrame:
    return merged_listing.withColumn("archive", F.col("source_archive")).withColumn("inner", F.regexp_replace("inner", "^[^/]*/", "")).drop("source_archive")


def removal_plan(listing: DataFrame, decisions: DataFrame) -> DataFrame:
    """(archive, inner, reason, backup_path): what to take out of which archive, and where a copy would go; nothing is done."""
    key: Column = F.concat(F.col("archive"), F.lit("!"), F.col("inner"))
    d = decisions.select(F.col("item_id").alias("_k"), "reason")
    return listing.join(d, key == F.col("_k")).select("archive", "inner", "reason", F.concat(F.lit("trash/"), "reason", F.lit("/"), "inner").alias("backup_path"))
