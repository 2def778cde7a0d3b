"""RAR and 7z files: their members from headers, and the content of those whose method the standard library can undo."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

RAR4, RAR5, SEVEN = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00", b"7z\xbc\xaf\x27\x1c"
#: Bytes beyond which a compressed 7z header is not unpacked.
MAX_HEADER = 64 << 20


@dataclass
class Member:
    """`read` gives the content, and raises where the method is not supported or a checksum does not hold; None for members without data."""

    name: str
    size: int
    packed: int
    crc: int | None
    read: Callable[[], bytes] | None


def kind_of(data: bytes) -> str | None:
    return "rar" if data[:7] == RAR4 or data[:8] == RAR5 else "7z" if data[:6] == SEVEN else None


def listed(data: bytes) -> Iterator[Member]:
    """Members of a RAR (4 and 5) or 7z file, folders left out; damaged headers raise ValueError."""
    try:
        if data[:8] == RAR5:
            yield from _rar5(data)
        elif data[:7] == RAR4:
            yield from _rar4(data)
        elif data[:6] == SEVEN:
            yield from _seven(data)
        else:
            raise ValueError("neither RAR nor 7z")
    except (struct.error, IndexError, UnicodeDecodeError, lzma.LZMAError, zlib.error, OSError) as e:
        raise ValueError(f"damaged headers: {e}") from e


def _checked(content: bytes, size: int, crc: int | None) -> bytes:
    if len(content) != size:
        raise ValueError(f"{len(content)} bytes instead of {size}")
    if crc is not None and zlib.crc32(content) != crc:
        raise ValueError("the checksum does not hold")
    return content


def _stored(data: bytes, at: int, packed: int, size: int, crc: int | None, method: int, stored: int) -> Callable[[], bytes]:
    def read() -> bytes:
        if method != stored:
            raise ValueError(f"method {method:#x} is not supported")
        return _checked(data[at : at + packed], size, crc)

    return read


def _vint(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, low ones first, and where it ends."""
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return out, at
        if shift > 63:
            raise ValueError("damaged headers: a number is too long")


def _rar5(data: bytes) -> Iterator[Member]:
    at = len(RAR5)
    while at < len(data):
        crc = struct.unpack_from("<I", data, at)[0]
        size, start = _vint(data, at + 4)
        end = start + size
        if end > len(data) or zlib.crc32(data[at + 4 : end]) != crc:
            raise ValueError("damaged headers: a checksum does not hold")
        kind, p = _vint(data, start)
        flags, p = _vint(data, p)
        if flags & 1:
            _, p = _vint(data, p)
        body = 0
        if flags & 2:
            body, p = _vint(data, p)
        if kind == 4:
            raise ValueError("headers are encrypted")
        if kind == 2:
            what, p = _vint(data, p)
            unpacked, p = _vint(data, p)
            _, p = _vint(data, p)
            p += 4 if what & 2 else 0
            check = None
            if what & 4:
                check, p = struct.unpack_from("<I", data, p)[0], p + 4
            method, p = _vint(data, p)
            _, p = _vint(data, p)
            n, p = _vint(data, p)
            name = data[p : p + n].decode("utf-8")
            if not what & 1:
                yield Member(name, unpacked, body, check, _stored(data, end, body, unpacked, check, method >> 7 & 7, 0))
        if kind == 5:
            return
        at = end + body


def _rar4(data: bytes) -> Iterator[Member]:
    at = len(RAR4)
    while at + 7 <= len(data):
        crc, kind, flags, size = struct.unpack_from("<HBHH", data, at)
        if size < 7 or zlib.crc32(data[at + 2 : at + size]) & 0xFFFF != crc:
            raise ValueError("damaged headers: a checksum does not hold")
        body = struct.unpack_from("<I", data, at + 7)[0] if flags & 0x8000 or kind == 0x74 else 0
        if kind == 0x74:
            packed, unpacked, _, check, _, _, method, n, _ = struct.unpack_from("<IIBIIBBHI", data, at + 7)
            p = at + 32
            if flags & 0x100:
                high = struct.unpack_from("<II", data, p)
                packed, unpacked, p = packed | high[0] << 32, unpacked | high[1] << 32, p + 8
            raw = data[p : p + n]
            name = _rar4_name(raw) if flags & 0x200 else raw.decode("utf-8", "replace")
            if flags & 0xE0 != 0xE0:
                yield Member(name.replace("\\", "/"), unpacked, packed, check, _stored(data, at + size, packed, unpacked, check, method, 0x30))
            body = packed
        if kind == 0x7B:
            return
        at += size + body


def _rar4_name(raw: bytes) -> str:
    """A name in its old encoding, a zero, and then what makes UTF-16 of it; without a zero it is UTF-8."""
    if b"\0" not in raw:
        return raw.decode("utf-8", "replace")
    old, new = raw.split(b"\0", 1)
    high, at, bits, flags, out = new[0], 1, 0, 0, []
    while at < len(new):
        if not bits:
            flags, at, bits = new[at], at + 1, 8
        bits -= 2
        step = flags >> bits & 3
        if at >= len(new):
            break
        if step < 2:
            out.append(new[at] | (high << 8 if step else 0))
            at += 1
        elif step == 2:
            out.append(new[at] | new[at + 1] << 8)
            at += 2
        else:
            n, at = new[at], at + 1
            add = None
            if n & 0x80:
                add, at = new[at], at + 1
            for _ in range((n & 0x7F) + 2):
                c = old[len(out)]
                out.append(c if add is None else (c + add & 0xFF) | high << 8)
    return b"".join(struct.pack("<H", c) for c in out).decode("utf-16-le", "replace")


class _Reader:
    """Reads the properties of 7z headers."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("damaged headers: cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        """As many following low bytes as the first byte has leading ones; its other bits are the highest."""
        first = self.byte()
        extra = 8 - (first ^ 0xFF).bit_length() if first != 0xFF else 8
        low = int.from_bytes(self.take(extra), "little")
        return low | ((first & (0x7F >> extra)) << 8 * extra if extra < 8 else 0)

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[i // 8] >> (7 - i % 8) & 1) for i in range(n)]

    def digests(self, n: int) -> list[int | None]:
        known = [True] * n if self.byte() else self.bits(n)
        return [struct.unpack("<I", self.take(4))[0] if k else None for k in known]


@dataclass
class _Folder:
    coders: list[tuple[bytes, bytes]]
    sizes: list[int]
    crc: int | None = None
    packed: int = 1
    files: int = 1


def _streams(r: _Reader) -> tuple[int, list[int], list[_Folder], list[int], list[int | None]]:
    """(where packed streams begin, their sizes, folders, sizes of the files in them, their checksums)."""
    start, packs, folders, counts, sizes, crcs = 0, [], [], None, [], []
    while (kind := r.number()) != 0:
        if kind == 6:
            start, n = r.number(), r.number()
            while (k := r.number()) != 0:
                if k == 9:
                    packs = [r.number() for _ in range(n)]
                elif k == 10:
                    r.digests(n)
        elif kind == 7:
            if r.number() != 11:
                raise ValueError("damaged headers: no folders")
            n = r.number()
            if r.byte():
                raise ValueError("folders are stored elsewhere")
            outs = []
            for _ in range(n):
                coders, n_in, n_out = [], 0, 0
                for _ in range(r.number()):
                    flag = r.byte()
                    name = r.take(flag & 15)
                    i, o = (r.number(), r.number()) if flag & 0x10 else (1, 1)
                    coders.append((name, r.take(r.number()) if flag & 0x20 else b""))
                    n_in, n_out = n_in + i, n_out + o
                for _ in range(n_out - 1):
                    r.number(), r.number()
                packed = n_in - (n_out - 1)
                for _ in range(packed if packed > 1 else 0):
                    r.number()
                folders.append(_Folder(coders, [], None, packed))
                outs.append(n_out)
            while (k := r.number()) != 0:
                if k == 12:
                    for f, o in zip(folders, outs, strict=True):
                        f.sizes = [r.number() for _ in range(o)]
                elif k == 10:
                    for f, c in zip(folders, r.digests(n), strict=True):
                        f.crc = c
        elif kind == 8:
            counts = [1] * len(folders)
            k = r.number()
            if k == 13:
                counts = [r.number() for _ in folders]
                k = r.number()
            for f, c in zip(folders, counts, strict=True):
                own = [r.number() for _ in range(c - 1)] if k == 9 and c else []
                sizes += [*own, _size(f) - sum(own)] if c else []
            if k == 9:
                k = r.number()
            unknown = sum(c for f, c in zip(folders, counts, strict=True) if c != 1 or f.crc is None)
            said = iter(r.digests(unknown) if k == 10 else [None] * unknown)
            for f, c in zip(folders, counts, strict=True):
                crcs += [f.crc] if c == 1 and f.crc is not None else [next(said) for _ in range(c)]
            while k != 0:
                k = r.number()
        else:
            raise ValueError(f"damaged headers: property {kind}")
    if counts is None:
        sizes, crcs, counts = [_size(f) for f in folders], [f.crc for f in folders], [1] * len(folders)
    for f, c in zip(folders, counts, strict=True):
        f.files = c
    return start, packs, folders, sizes, crcs


def _size(f: _Folder) -> int:
    return f.sizes[-1] if f.sizes else 0


def _unpacked(f: _Folder, packed: bytes) -> bytes:
    """A folder's content; one coder of those the standard library has."""
    if len(f.coders) != 1 or f.packed != 1:
        raise ValueError(f"{len(f.coders)} methods in a row are not supported")
    (name, props), size = f.coders[0], _size(f)
    if name == b"\x00":
        out = packed[:size]
    elif name == b"\x03\x01\x01":
        d = props[0]
        one = {"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": max(4096, struct.unpack("<I", props[1:5])[0])}
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[one]).decompress(packed, size)
    elif name == b"\x21":
        b = props[0]
        n = 0xFFFFFFFF if b == 40 else (2 | b & 1) << b // 2 + 11
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": n}]).decompress(packed, size)
    elif name == b"\x04\x01\x08":
        out = zlib.decompressobj(-15).decompress(packed, size) if size else b""
    elif name == b"\x04\x02\x02":
        out = bz2.BZ2Decompressor().decompress(packed, size)
    else:
        raise ValueError(f"method {name.hex()} is not supported")
    return _checked(out, size, f.crc)


def _seven(data: bytes) -> Iterator[Member]:
    crc, offset, size, next_crc = struct.unpack_from("<IQQI", data, 8)
    if zlib.crc32(data[12:32]) != crc:
        raise ValueError("damaged headers: a checksum does not hold")
    if not size:
        return
    head = data[32 + offset : 32 + offset + size]
    if len(head) < size or zlib.crc32(head) != next_crc:
        raise ValueError("damaged headers: a checksum does not hold")
    r = _Reader(head)
    kind = r.number()
    while kind == 0x17:  # a packed header, which may be packed again
        start, packs, folders, _, _ = _streams(r)
        if _size(folders[0]) > MAX_HEADER:
            raise ValueError("the header is too large")
        r = _Reader(_unpacked(folders[0], data[32 + start : 32 + start + packs[0]]))
        kind = r.number()
    if kind != 1:
        raise ValueError(f"damaged headers: property {kind}")
    start, packs, folders, sizes, crcs = 0, [], [], [], []
    names, empty, empty_file = [], [], []
    while (kind := r.number()) != 0:
        if kind == 2:
            while r.number() != 0:
                r.take(r.number())
        elif kind == 3:
            _streams(r)
        elif kind == 4:
            start, packs, folders, sizes, crcs = _streams(r)
        elif kind == 5:
            n = r.number()
            empty = [False] * n
            while (k := r.number()) != 0:
                body = _Reader(r.take(r.number()))
                if k == 14:
                    empty = body.bits(n)
                elif k == 15:
                    empty_file = body.bits(sum(empty))
                elif k == 17:
                    if body.byte():
                        raise ValueError("names are stored elsewhere")
                    names = body.data[1:].decode("utf-16-le").split("\0")[:n]
        else:
            raise ValueError(f"damaged headers: property {kind}")
    # the folder of each file with data, and where the file begins in it
    place, at, first = [], 32 + start, 0
    for f in folders:
        inside = 0
        for k in range(f.files):
            place.append((f, at, sum(packs[first : first + f.packed]), inside, k))
            inside += sizes[len(place) - 1]
        at += sum(packs[first : first + f.packed])
        first += f.packed
    kept: dict[int, bytes] = {}

    def reader(i: int) -> Callable[[], bytes]:
        f, at, packed, inside, _ = place[i]

        def read() -> bytes:
            if id(f) not in kept:  # one folder at a time: its files follow each other
                kept.clear()
                kept[id(f)] = _unpacked(f, data[at : at + packed])
            return _checked(kept[id(f)][inside : inside + sizes[i]], sizes[i], crcs[i])

        return read

    full, blank = iter(range(len(place))), iter(empty_file)
    for name, is_empty in zip(names, empty, strict=True):
        if is_empty:
            if next(blank, False):  # else a folder
                yield Member(name, 0, 0, 0, lambda: b"")
            continue
        i = next(full)
        # packed sizes are a folder's, which its first file shows
        yield Member(name, sizes[i], place[i][2] if place[i][4] == 0 else 0, crcs[i], reader(i))
