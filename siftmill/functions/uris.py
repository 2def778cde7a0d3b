"""URIs and paths of files and archive members as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Archive extensions that may be followed by `!` and an inner path.
ARCHIVE_EXTENSIONS = ("zip", "cbz", "cbr", "rar", "7z", "tar")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "avif", "jxl", "tiff")
_MARK = r"\.(?:" + "|".join(ARCHIVE_EXTENSIONS) + ")!"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    """The part before the last slash; the root keeps its slash."""
    up = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when((up == "") & path.startswith("/"), "/").otherwise(up)


def extension(path: Column) -> Column:
    """The last suffix with its dot, lower case; leading dots of a name do not start one."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def without_extension(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.length(path) - F.length(extension(path)))


def normalise_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def strip_quotes(path: Column) -> Column:
    return F.btrim(F.trim(path), F.lit("\"'"))


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder.endswith("/"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))


def relative_to(path: Column, base: Column) -> Column:
    """`path` below `base`; `path` itself where it is elsewhere."""
    b = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(b), F.substr(path, F.length(b) + 1)).otherwise(path)


def resolve_virtual(path: Column, suffix: str = ".folderzip") -> Column:
    """A virtual archive's folder: the path without `suffix`."""
    return F.when(path.endswith(suffix), F.substr(path, F.lit(1), F.length(path) - len(suffix))).otherwise(path)


def split_member(path: Column) -> Column:
    """struct<archive, inner>: cut at the `!` after an archive extension.

    Per extension its first mark counts, and of these the last; both are null for paths that are not in an archive.
    """
    at = F.greatest(*[F.when(F.instr(path, f".{e}!") > 0, F.instr(path, f".{e}!") + len(e) + 1).otherwise(F.lit(0)) for e in ARCHIVE_EXTENSIONS])
    inside = at > 0
    return F.struct(F.when(inside, F.substr(path, F.lit(1), at - 1)).alias("archive"), F.when(inside, F.substr(path, at + 1)).alias("inner"))


def canonical(path: Column) -> Column:
    """`file:///PATH`, or `archive:///ARCHIVE!INNER`; members of `merged_*.zip` get the archive that their first folder names.

    Paths are taken to be absolute: resolving against a working folder is for the caller.
    """
    m = split_member(path)
    archive, inner = normalise_slashes(m["archive"]), normalise_slashes(m["inner"])
    merged = base_name(archive).rlike(r"^merged_.*\.zip$")
    first = F.substring_index(inner, "/", 1)
    rest = F.when(F.instr(inner, "/") > 0, F.substr(inner, F.length(first) + 2)).otherwise("")
    moved = F.concat(F.lit("archive:///"), join_path(dir_name(archive), F.concat(first, F.lit(".zip"))), F.lit("!"), rest)
    plain = F.concat(F.lit("archive:///"), archive, F.lit("!"), inner)
    return F.when(m["archive"].isNull(), F.concat(F.lit("file:///"), normalise_slashes(path))).when(merged, moved).otherwise(plain)


def catalog_parts(uri: Column) -> Column:
    """struct<uri, filename, file_extension, base_uri, archive_name, source_type> as the catalog stores them.

    base_uri is the URI without the extension, so that one work in two formats has one. Archive members are found
    behind `!/` and, as canonical URIs have it, behind `!`. The null URI gives null parts.
    The parts are made once, however many of them a query names.
    """
    return F.transform(F.array(uri), _catalog_parts)[0]


def _catalog_parts(uri: Column) -> Column:
    is_archive, is_url = uri.startswith("archive://"), uri.contains("://")
    body = F.substr(uri, F.lit(11))
    sep = F.when(F.instr(body, "!/") > 0, F.lit("!/")).otherwise(F.lit("!"))
    inside = F.instr(body, "!") > 0
    archive = F.when(inside, F.substr(body, F.lit(1), F.instr(body, "!") - 1)).otherwise(body)
    archive = F.when(F.instr(body, "!/") > 0, F.substr(body, F.lit(1), F.instr(body, "!/") - 1)).otherwise(archive)
    inner = F.substr(body, F.length(archive) + F.length(sep) + 1)
    path = F.url_decode(F.regexp_extract(uri, r"^[^:]+://[^/?#]*([^?#]*)", 1))
    filename = F.when(is_archive & inside, inner).when(is_archive, base_name(body)).when(is_url, base_name(path)).otherwise(base_name(uri))
    inner_dir, stem = dir_name(inner), without_extension(base_name(inner))
    joined = F.concat(F.lit("archive://"), archive, sep, F.when(inner_dir == "", "").otherwise(F.concat(inner_dir, F.lit("/"))), stem)
    base = (
        F.when(is_archive & inside, joined)
        .when(is_archive, F.concat(F.lit("archive://"), without_extension(body)))
        .when(is_url, F.concat(F.regexp_extract(uri, r"^([^:]+://[^/?#]*)", 1), without_extension(path)))
        .otherwise(without_extension(uri))
    )
    kind = F.when(is_archive, "archive").when(is_url, "url").otherwise("file")
    return F.when(
        uri.isNotNull(),
        F.struct(
            uri.alias("uri"), filename.alias("filename"), extension(filename).alias("file_extension"), base.alias("base_uri"),
            F.when(is_archive & inside, base_name(archive)).otherwise("").alias("archive_name"), kind.alias("source_type"),
        ),
    )


def display_parts(uri: Column) -> Column:
    """struct<filename, file_format, uri_without_format, archive_name> for `file:///` and `archive://` URIs, percent-decoded.

    The format has no dot. Without a format the URI stays as it is. Other schemes give null parts but for the URI.
    """
    is_file, is_archive = uri.startswith("file:///"), uri.startswith("archive://")
    prefix = F.when(uri.startswith("archive:///"), "archive:///").otherwise("archive://")
    body = F.url_decode(F.replace(F.when(is_file, F.substr(uri, F.lit(9))).otherwise(F.substr(uri, F.length(prefix) + 1)), F.lit("+"), F.lit("%2B")))
    archive = F.when(is_archive, F.when(F.instr(body, "!/") > 0, F.substring_index(body, "!/", 1)).otherwise(F.substring_index(body, "!", 1)))
    inner = F.when(is_archive & (F.instr(body, "!") > 0), F.regexp_replace(F.substr(body, F.length(archive) + 2), "^/*(?=.)", ""))
    target = F.when(is_file, body).otherwise(inner)
    name = F.when(target != "", base_name(target))
    fmt = F.when(target != "", F.regexp_replace(extension(target), r"^\.", ""))
    sep = F.when(uri.contains("!/"), "!/").otherwise("!")
    bare = F.when(is_file, F.concat(F.lit("file:///"), without_extension(body))).otherwise(F.concat(prefix, archive, sep, F.when(uri.contains("!/"), "").otherwise("/"), without_extension(inner)))
    return F.struct(
        name.alias("filename"), fmt.alias("file_format"), F.when(fmt != "", bare).otherwise(uri).alias("uri_without_format"),
        F.when(is_archive, base_name(archive)).alias("archive_name"),
    )


def original_path(uri: Column) -> Column:
    """The local path of a `file:` or `archive:` URI, percent-decoded; anything else as it is."""
    body = F.regexp_replace(uri, r"^(?:file|archive):/{2,3}(?=/|[A-Za-z]:|[^/])", "")
    return F.when(uri.rlike(r"^(?:file|archive)://"), F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))).otherwise(uri)


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:" + "|".join(IMAGE_EXTENSIONS) + ")$")
