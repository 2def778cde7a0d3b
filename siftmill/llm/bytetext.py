"""Vectorised word and hash primitives over the UTF-8 bytes of one text.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; as those bytes never occur inside a
multi-byte character, this equals the pattern [^\\x20\\x09-\\x0D]+ over code points.
Hashes are 64-bit: a polynomial over an odd base modulo 2**64 of per-byte random numbers, then a mixing step. They
depend on the bytes of a span only, never on where it stands.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_T = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)
#: Bytes hashed at a time; bounds memory for very long texts.
BLOCK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        m = max(n, 2 * len(_pow), 4096)
        b, i = np.full(m, _BASE, np.uint64), np.full(m, _INV, np.uint64)
        b[0] = i[0] = 1
        with np.errstate(over="ignore"):
            _pow, _ipow = np.cumprod(b), np.cumprod(i)
    return _pow, _ipow


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of buf[s:e] for each span; spans are sorted by start and may overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + BLOCK)))
        top = int(ends[i:j].max())
        p, ip = _powers(top - base + 1)
        with np.errstate(over="ignore"):
            q = np.zeros(top - base + 1, np.uint64)
            np.cumsum(_T[buf[base:top]] * p[: top - base], out=q[1:])
            s = starts[i:j] - base
            out[i:j] = (q[ends[i:j] - base] - q[s]) * ip[s]
        i = j
    return mix(out)


def gram_hashes(buf: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, hashes of all k-byte strings from there on), block by block."""
    n = len(buf) - k + 1
    for base in range(0, max(n, 0), BLOCK):
        m = min(BLOCK, n - base)
        p, ip = _powers(m + k)
        with np.errstate(over="ignore"):
            q = np.zeros(m + k, np.uint64)
            np.cumsum(_T[buf[base : base + m + k - 1]] * p[: m + k - 1], out=q[1:])
            yield base, mix((q[k : k + m] - q[:m]) * ip[:m])


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], (~SPACE[buf]).astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes, order kept."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc = (acc + h[j : j + n]) * U(0xD6E8FEB86659FD93) + U(j + 1)
    return mix(acc)


def as_bytes(text) -> bytes:
    return b"" if text is None else text.encode("utf-8") if isinstance(text, str) else bytes(text)


def as_array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each value of a string or binary column, None for null."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py()


#: Rows that Spark puts into one Arrow batch for these operators. Texts may be long, and a worker and the JVM each hold a batch and copies of it.
BATCH_ROWS = 1000
#: And bytes, for rows that hold long lists. A batch of one row may be larger.
BATCH_BYTES = 8 << 20


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, giving freed memory back at the end of a task: workers live on, and would hold on to each stage's most."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return inner


def small_batches(spark) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS where it is larger, and to BATCH_BYTES where it is not set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)
