"""Fingerprints and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits per chunk: 52 bits, so that a chunk is a non-negative bigint in every engine.
CHUNK = 13


def hex_chunks(h: Column, digits: int) -> Column:
    """array<bigint> of a hexadecimal string of known length, CHUNK digits each; null for null or non-hex digits."""
    low = F.lower(h)
    parts = [F.conv(F.substr(low, F.lit(i + 1), F.lit(CHUNK)), 16, 10).cast("bigint") for i in range(0, digits, CHUNK)]
    return F.when(low.rlike(rf"^[0-9a-f]{{{digits}}}$"), F.array(*parts))


def chunk_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two chunk arrays of equal length; null if the lengths differ."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), bits)


def hamming(a: Column, b: Column, digits: int = 25) -> Column:
    """Hamming distance of hexadecimal hashes, case-insensitive; null where either is not a hash of `digits` digits, so
    that hashes of different sizes are never comparable."""
    return chunk_distance(hex_chunks(a, digits), hex_chunks(b, digits))


def hamming_any(a: Column, b: Column, max_digits: int = 64) -> Column:
    """As `hamming`, for hashes whose length is only known at run time: equal lengths of up to `max_digits`."""
    la, lb = F.lower(a), F.lower(b)
    part = lambda h, i: F.conv(F.substr(h, i, F.lit(CHUNK)), 16, 10).cast("bigint")
    at = F.sequence(F.lit(1), F.greatest(F.length(la), F.lit(1)), F.lit(CHUNK))
    bits = F.aggregate(F.transform(at, lambda i: F.bit_count(part(la, i).bitwiseXOR(part(lb, i)))), F.lit(0), lambda s, x: s + x)
    ok = (F.length(la) == F.length(lb)) & F.length(la).between(1, max_digits) & la.rlike("^[0-9a-f]+$") & lb.rlike("^[0-9a-f]+$")
    return F.when(ok, bits)


def similarity(distance: Column, bits: int) -> Column:
    """1 - d / bits, over the hash's own number of bits, so never negative."""
    return 1 - distance / F.lit(bits)


def inverse_similarity(metric: Column) -> Column:
    """1 - min(metric, 1), for perceptual distances without an upper bound."""
    return 1 - F.least(metric, F.lit(1.0))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def cache_key(path: Column, size: Column, mtime: Column, hash_size: Column | None = None) -> Column:
    """Sixteen hexadecimal digits of the MD5 of path, size, mtime (and hash size) joined by underscores."""
    parts = [path, size.cast("string"), mtime.cast("string")] + ([hash_size.cast("string")] if hash_size is not None else [])
    return F.substr(F.md5(F.concat_ws("_", *parts)), F.lit(1), F.lit(16))


def hash_params(text: Column) -> Column:
    """map<string,string> of `hash_size=10;hash_version=1`."""
    return F.str_to_map(text, F.lit(";"), F.lit("="))
