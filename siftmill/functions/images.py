"""Encoded images in binary columns: PNG and BMP to pixels and back, with a ladder of readers for damaged ones, and all pixel measures in one pass.

Pixels are as Spark's image reader gives them: rows of interleaved bytes, BGR or BGRA, one channel for gray.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.functions import pixels

PNG_MARK = b"\x89PNG\r\n\x1a\n"
#: Pixels of an image beyond which it is not decoded but reported.
MAX_PIXELS = 200_000_000
#: Decoded bytes that a batch of results holds, but for a single larger image.
BATCH_BYTES = 16 << 20
# Fixed values of the format: samples of a pixel by colour type; start and step (x, y) of the seven interlacing passes.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _checked(h: int, w: int) -> None:
    if h <= 0 or w <= 0:
        raise ValueError("no pixels")
    if h * w > MAX_PIXELS:
        raise ValueError(f"{w} x {h} pixels are more than {MAX_PIXELS}")


def _unfiltered(raw: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """Scan lines of `width` bytes without their filters; `step` is the distance to the same sample of the pixel before."""
    out = np.zeros((rows + 1, width), np.uint8)  # the line above the first is zeros
    raw = raw.reshape(rows, width + 1)
    for y in range(rows):
        kind, line, up = raw[y, 0], raw[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            for s in range(step):
                out[y + 1, s::step] = np.cumsum(line[s::step], dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            out[y + 1] = _mean_line(line, up, step) if kind == 3 else _paeth_line(line, up, step)
        else:
            raise ValueError(f"filter {kind}")
    return out[1:]


def _mean_line(line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    got, above, was = bytearray(len(line)), up.tolist(), line.tolist()
    for i, v in enumerate(was):
        left = got[i - step] if i >= step else 0
        got[i] = (v + (left + above[i]) // 2) & 255
    return np.frombuffer(bytes(got), np.uint8)


def _paeth_line(line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    got, above = bytearray(len(line)), up.tolist()
    for i, v in enumerate(line.tolist()):
        a, c = (got[i - step], above[i - step]) if i >= step else (0, 0)
        b = above[i]
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        got[i] = (v + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
    return np.frombuffer(bytes(got), np.uint8)


def _samples(lines: np.ndarray, width: int, samples: int, depth: int) -> np.ndarray:
    """(rows, width, samples) of packed scan lines; of 16 bits the high ones."""
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
        lines = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    return lines[:, : width * samples].reshape(len(lines), width, samples)


def png_pixels(data: bytes, lenient: bool = False) -> np.ndarray:
    """(height, width, channels) of a PNG. Checksums, the end mark and all lines must be there; `lenient` asks for none of these, and what is missing is 0."""
    if data[:8] != PNG_MARK:
        raise ValueError("not a PNG")
    at, parts, head, palette, alpha, ended = 8, [], None, None, None, False
    while at + 8 <= len(data) and not ended:
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if not lenient and (len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body))):
            raise ValueError(f"checksum of {kind.decode('latin-1')}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not (ended or lenient):
        raise ValueError("cut short")
    w, h, depth, colour, _, _, interlaced = head
    _checked(h, w)
    if colour not in _SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise ValueError(f"colour type {colour} with {depth} bits")
    samples = _SAMPLES[colour]
    passes = [(x, y, sx, sy) for x, y, sx, sy in _PASSES if x < w and y < h] if interlaced else [(0, 0, 1, 1)]
    sizes = [(-(-(h - y) // sy), -(-(w - x) // sx)) for x, y, sx, sy in passes]
    widths = [-(-c * samples * depth // 8) for _, c in sizes]
    need = sum(r * (b + 1) for (r, _), b in zip(sizes, widths, strict=True))
    stream, raw = zlib.decompressobj(), b""
    try:
        raw = stream.decompress(b"".join(parts), need)
    except zlib.error:
        if not lenient:
            raise
        raw = _what_is_there(b"".join(parts), need)
    if len(raw) < need:
        if not lenient:
            raise ValueError("lines are missing")
        raw = raw + bytes(need - len(raw))
    buf, at = np.frombuffer(raw, np.uint8), 0
    x = np.zeros((h, w, samples), np.uint8)
    for (x0, y0, sx, sy), (r, c), b in zip(passes, sizes, widths, strict=True):
        lines = _unfiltered(buf[at : at + r * (b + 1)], r, b, max(1, samples * depth // 8))
        x[y0::sy, x0::sx] = _samples(lines, c, samples, depth)
        at += r * (b + 1)
    if colour == 3:
        if palette is None or int(x.max()) >= len(palette):
            raise ValueError("colours are missing")
        if alpha is None:
            return np.ascontiguousarray(palette[x[:, :, 0]][:, :, ::-1])
        full = np.full(len(palette), 255, np.uint8)
        full[: len(alpha)] = alpha[: len(full)]
        return np.dstack([palette[x[:, :, 0]][:, :, ::-1], full[x[:, :, 0]]])
    if colour == 0:
        return x if depth >= 8 else (x.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if colour == 4:
        return np.dstack([x[:, :, 0]] * 3 + [x[:, :, 1]])
    return np.ascontiguousarray(x[:, :, [2, 1, 0, 3][:samples]])


def _what_is_there(data: bytes, need: int) -> bytes:
    """What of a damaged stream comes before the damage, found in small steps."""
    stream, out = zlib.decompressobj(), []
    for i in range(0, len(data), 64):
        try:
            out.append(stream.decompress(data[i : i + 64]))
        except zlib.error:
            break
    return b"".join(out)[:need]


def png_bytes(x: np.ndarray) -> bytes:
    """A PNG of gray, BGR or BGRA pixels."""
    h, w, c = x.shape
    lines = np.zeros((h, w * c + 1), np.uint8)
    lines[:, 1:] = (x if c == 1 else x[:, :, [2, 1, 0, 3][:c]]).reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def bmp_pixels(data: bytes, lenient: bool = False) -> np.ndarray:
    """(height, width, channels) of an uncompressed BMP of 1, 4, 8, 24 or 32 bits; `lenient`: missing lines are 0."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP")
    start, head, w, h, _, depth, packed = struct.unpack("<IIiiHHI", data[10:34])
    used = struct.unpack("<I", data[46:50])[0]
    _checked(abs(h), w)
    # masks of the usual order are no compression
    if depth not in (1, 4, 8, 24, 32) or packed not in ((0, 3) if depth == 32 else (0,)):
        raise ValueError(f"{depth} bits, compression {packed}")
    line = -(-w * depth // 32) * 4
    body = data[start : start + line * abs(h)]
    if len(body) < line * abs(h):
        if not lenient:
            raise ValueError("lines are missing")
        body = body + bytes(line * abs(h) - len(body))
    rows = np.frombuffer(body, np.uint8).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if depth >= 24:
        x = rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, :3]
        return np.ascontiguousarray(x)
    n = min(used or 1 << depth, 1 << depth)
    palette = np.frombuffer(data[14 + head : 14 + head + 4 * n], np.uint8).reshape(-1, 4)[:, :3]
    index = _samples(np.ascontiguousarray(rows), w, 1, depth)[:, :, 0]
    if int(index.max()) >= len(palette):
        raise ValueError("colours are missing")
    return palette[index]


def bmp_bytes(x: np.ndarray) -> bytes:
    """A BMP of BGR pixels, 24 bits, lines from the bottom."""
    h, w, _ = x.shape
    line = -(-w * 24 // 32) * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, : w * 3] = x[::-1].reshape(h, -1)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + line * h, 0, 54, 40, w, h, 1, 24, 0, line * h, 0, 0, 0, 0) + rows.tobytes()


def _own(data: bytes, lenient: bool) -> np.ndarray:
    if data[:2] == b"BM":
        return bmp_pixels(data, lenient)
    if data[:8] == PNG_MARK:
        return png_pixels(data, lenient)
    raise ValueError("neither PNG nor BMP")


def _installed(data: bytes) -> np.ndarray:
    """By an imaging library, where workers have one: other formats, and what the strict readers refuse."""
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise ValueError("no other reader is installed") from e
    with Image.open(io.BytesIO(data)) as im:
        _checked(im.height, im.width)
        if im.mode in ("1", "L"):
            return np.asarray(im.convert("L"))[:, :, None]
        has_alpha = "A" in im.mode or "transparency" in im.info
        x = np.asarray(im.convert("RGBA" if has_alpha else "RGB"))
        return np.ascontiguousarray(x[:, :, [2, 1, 0, 3][: x.shape[2]]])


#: The ladder: verified first, then by another library, then whatever can be read without checks.
READERS: list[tuple[str, Callable[[bytes], np.ndarray]]] = [("verified", lambda d: _own(d, False)), ("library", _installed), ("unchecked", lambda d: _own(d, True))]


def pixels_of(data: bytes | None) -> tuple[np.ndarray | None, str | None, str | None]:
    """(pixels, reader, error): by the first reader of the ladder that can; null pixels and all errors if none can."""
    if not data:
        return None, None, "no bytes"
    said = []
    for name, read in READERS:
        try:
            return read(bytes(data)), name, None
        except Exception as e:  # noqa: BLE001  damaged files fail in many ways; each is a row that says so
            said.append(f"{name}: {e}")
    return None, None, "; ".join(said)


def results(batches: Iterator[pa.RecordBatch], content_col: str, kept: Sequence[str], out: Sequence[tuple[str, str, pa.DataType]], one: Callable[[bytes | None], tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of `kept` columns and what `one` makes of each content: cut where bytes and arrays of results reach BATCH_BYTES."""

    def put(b: pa.RecordBatch, start: int, got: list[tuple]) -> pa.RecordBatch:
        part = b.slice(start, len(got))
        cols = [pa.array(c, t) for c, (_, _, t) in zip(zip(*got, strict=True), out, strict=True)]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *cols], [*kept, *(n for n, _, _ in out)])

    for b in batches:
        start, got, size = 0, [], 0
        for i, content in enumerate(b.column(content_col)):
            got.append(one(content.as_py()))
            size += sum(v.nbytes if isinstance(v, np.ndarray) else len(v) for v in got[-1] if isinstance(v, bytes | np.ndarray))
            if size >= BATCH_BYTES:
                yield put(b, start, got)
                start, got, size = i + 1, [], 0
        if got:
            yield put(b, start, got)


def _mapped(rows: DataFrame, content_col: str, out: Sequence[tuple[str, str, pa.DataType]], one: Callable[[bytes | None], tuple]) -> DataFrame:
    """The rows without `content_col` and with what `one` makes of it; batches of results are cut by their size."""
    kept = [c for c in rows.columns if c != content_col]
    made = {n for n, _, _ in out}
    if clash := made & set(kept):
        raise ValueError(f"columns {', '.join(sorted(clash))} would be made twice")
    src = rows.select(*kept, F.col(content_col).alias(content_col))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != content_col] + [f"{n} {t}" for n, t, _ in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return results(batches, content_col, kept, out, one)

    return src.mapInArrow(run, schema)


def decoded(rows: DataFrame, content_col: str = "content") -> DataFrame:
    """The rows with (height, width, channels int, data binary, reader, error string) in place of an encoded image.

    A null, empty or unreadable image is a row with an error. Rows keep their other columns; an empty table gives an empty result.
    """

    def one(content: bytes | None) -> tuple:
        x, reader, error = pixels_of(content)
        return (None, None, None, None, None, error) if x is None else (*x.shape, x.tobytes(), reader, None)

    i32 = pa.int32()
    return _mapped(rows, content_col, [("height", "int", i32), ("width", "int", i32), ("channels", "int", i32), ("data", "binary", pa.binary()), ("reader", "string", pa.string()), ("error", "string", pa.string())], one)


_FLAGS = ["is_grayscale", "is_white_image", "is_pure_white", "is_pure_black"]
_SCORES = ["channel_std", "grayscale_score", "white_score", "black_score", "colorfulness"]


def measured(rows: DataFrame, content_col: str = "content", hash_size: int = 10) -> DataFrame:
    """The rows with all measures of an encoded image in its place: height, width, channels, phash, sharpness, the colour measures, text_total, reader, error.

    Each image is decoded once, and no pixels leave the task. Cases are those of `decoded`.
    """
    names = [("height", "int", pa.int32()), ("width", "int", pa.int32()), ("channels", "int", pa.int32()), ("phash", "string", pa.string()), ("sharpness", "long", pa.int64())]
    names += [(n, "boolean", pa.bool_()) for n in _FLAGS] + [(n, "double", pa.float64()) for n in _SCORES] + [("text_total", "double", pa.float64()), ("reader", "string", pa.string()), ("error", "string", pa.string())]

    def one(content: bytes | None) -> tuple:
        x, reader, error = pixels_of(content)
        if x is None:
            return (*[None] * (len(names) - 1), error)
        colour = pixels.colour_stats_of(x)
        flags = [bool(colour[n]) for n in _FLAGS] + [float(colour[n]) for n in _SCORES]
        return (*x.shape, pixels.phash_of(x, hash_size), pixels.sharpness_of(x), *flags, float(pixels.text_scores_of(x, colour)["total"]), reader, None)

    return _mapped(rows, content_col, names, one)


def thumbnails(rows: DataFrame, content_col: str = "content", side: int = 64) -> DataFrame:
    """The rows with (thumb binary, error string) in place of an encoded image: its luma at side * side pixels, as 16-bit fractions."""

    def one(content: bytes | None) -> tuple:
        x, _, error = pixels_of(content)
        return (None, error) if x is None else (thumbnail_of(x, side), None)

    return _mapped(rows, content_col, [("thumb", "binary", pa.binary()), ("error", "string", pa.string())], one)


def thumbnail_of(x: np.ndarray, side: int = 64) -> bytes:
    return np.rint(pixels._resize(pixels._gray(x), side) * 257).astype("<u2").tobytes()
