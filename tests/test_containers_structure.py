"""RAR and 7z files written by hand, encodings of names, rank profiles, structure features and components."""

import bz2
import hashlib
import io
import lzma
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest

from siftmill.functions import images
from siftmill.operators import language_profiles, structure
from siftmill.sources import archives, containers

FILES = [("a.txt", b"hello"), ("dé/日本.png", bytes(range(256)) * 3), ("empty", b"")]


def vint(n):
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def rar5(files, method=0, folder="dir"):
    def block(kind, body, data=b"", flags=0):
        head = vint(kind) + vint(flags | (2 if data or kind == 2 else 0)) + (vint(len(data)) if data or kind == 2 else b"") + body
        head = vint(len(head)) + head
        return struct.pack("<I", zlib.crc32(head)) + head + data

    out = containers.RAR5 + block(1, vint(0))
    out += block(2, vint(1) + vint(0) + vint(16) + vint(0) + vint(1) + vint(len(folder)) + folder.encode())
    for name, data in files:
        raw = name.encode()
        out += block(2, vint(6) + vint(len(data)) + vint(32) + struct.pack("<I", 1) + struct.pack("<I", zlib.crc32(data)) + vint(method << 7) + vint(1) + vint(len(raw)) + raw, data)
    return out + block(5, vint(0))


def rar4(files, method=0x30):
    def block(kind, flags, body, data=b""):
        head = struct.pack("<BHH", kind, flags, 7 + len(body)) + body
        return struct.pack("<H", zlib.crc32(head) & 0xFFFF) + head + data

    out = containers.RAR4 + block(0x73, 0, bytes(6))
    for name, data in files:
        raw = name.encode()
        out += block(0x74, 0x8200, struct.pack("<IIBIIBBHI", len(data), len(data), 0, zlib.crc32(data), 0, 29, method, len(raw), 32) + raw, data)
    out += block(0x74, 0x80E0, struct.pack("<IIBIIBBHI", 0, 0, 0, 0, 0, 20, 0x30, 3, 16) + b"dir")
    return out + block(0x7B, 0, b"")


def number(n):
    for extra in range(8):
        if n < 1 << 7 * (extra + 1):
            return bytes([(0xFF << (8 - extra) & 0xFF) | n >> 8 * extra]) + (n & (1 << 8 * extra) - 1).to_bytes(extra, "little")
    return b"\xff" + n.to_bytes(8, "little")


def seven(files, coder=b"\x00", props=b"", pack=lambda d: d, packed_header=False, solid=True):
    full = [(n, d) for n, d in files if d]
    groups = [full] if solid else [[f] for f in full]
    streams = [pack(b"".join(d for _, d in g)) for g in groups]
    one = lambda c, p: number(1) + bytes([len(c) | (0x20 if p else 0)]) + c + (number(len(p)) + p if p else b"")
    info = b"\x06" + number(0) + number(len(streams)) + b"\x09" + b"".join(number(len(s)) for s in streams) + b"\x00"
    info += b"\x07\x0b" + number(len(groups)) + b"\x00" + b"".join(one(coder, props) for _ in groups) + b"\x0c" + b"".join(number(sum(len(d) for _, d in g)) for g in groups) + b"\x00"
    info += b"\x08\x0d" + b"".join(number(len(g)) for g in groups) + b"\x09" + b"".join(number(len(d)) for g in groups for _, d in g[:-1]) + b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(d)) for _, d in full) + b"\x00"
    every = [*files, ("dir", None)]
    empty = [not d for _, d in every]
    bits = lambda xs: int("".join("1" if x else "0" for x in xs).ljust(-(-len(xs) // 8) * 8, "0"), 2).to_bytes(-(-len(xs) // 8), "big")
    prop = lambda k, b: bytes([k]) + number(len(b)) + b
    head = b"\x01\x04" + info + b"\x00\x05" + number(len(every)) + prop(14, bits(empty)) + prop(15, bits([d is not None for (_, d), e in zip(every, empty, strict=True) if e]))
    head += prop(17, b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in every)) + b"\x00\x00"
    body = b"".join(streams)
    if packed_header:
        small = lzma.compress(head, lzma.FORMAT_RAW, filters=[LZMA])
        at, body = len(body), body + small
        head = b"\x17\x06" + number(at) + number(1) + b"\x09" + number(len(small)) + b"\x00\x07\x0b" + number(1) + b"\x00" + one(b"\x03\x01\x01", PROPS) + b"\x0c" + number(len(head)) + b"\x0a\x01" + struct.pack("<I", zlib.crc32(head)) + b"\x00\x00"
    start = struct.pack("<QQI", len(body), len(head), zlib.crc32(head))
    return containers.SEVEN + b"\x00\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + head


LZMA = {"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}
PROPS = bytes([93]) + struct.pack("<I", 1 << 16)


def deflate(d):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(d) + c.flush()


CODERS = {
    "copy": (b"\x00", b"", lambda d: d), "lzma": (b"\x03\x01\x01", PROPS, lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=[LZMA])),
    "lzma2": (b"\x21", bytes([8]), lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}])),
    "deflate": (b"\x04\x01\x08", b"", deflate), "bzip2": (b"\x04\x02\x02", b"", bz2.compress),
}


@pytest.mark.parametrize("solid", [True, False])
@pytest.mark.parametrize("coder", CODERS)
def test_seven_zip(coder, solid):
    for packed_header in (False, True):
        got = list(containers.listed(seven(FILES, *CODERS[coder], packed_header=packed_header, solid=solid)))
        assert [(m.name, m.size, m.read()) for m in got] == [(n, len(d), d) for n, d in FILES]
        assert [m.crc for m in got] == [zlib.crc32(d) for _, d in FILES]


def test_literal_empty_seven_zip():
    assert list(containers.listed(bytes.fromhex("377abcaf271c00048d9bd50f" + "00" * 20))) == []


@pytest.mark.parametrize("make", [rar5, rar4])
def test_rar(make):
    got = list(containers.listed(make(FILES)))
    assert [(m.name, m.size, m.crc, m.read()) for m in got] == [(n, len(d), zlib.crc32(d), d) for n, d in FILES]
    packed = list(containers.listed(make(FILES, 3 if make is rar5 else 0x33)))
    assert [m.name for m in packed] == [n for n, _ in FILES]
    with pytest.raises(ValueError, match="not supported"):
        packed[0].read()


def test_old_rar_names():
    assert containers._rar4_name(b"ab\0" + bytes([0x30, 0b00_01_10_00, ord("a"), 0x42, 0xE5, 0x65])) == "aあ日"
    assert containers._rar4_name(b"abcd\0" + bytes([0x00, 0b11_000000, 2])) == "abcd"


def test_members_of_every_container(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for n, d in FILES:
            f.writestr(n, d)
    bad = bytearray(rar5(FILES))
    bad[bad.index(b"hello")] ^= 1
    unknown = seven(FILES, b"\x06\xf1\x07\x01", b"")
    rows = [("x.zip", z.getvalue()), ("x.rar", rar5(FILES)), ("old.rar", rar4(FILES)), ("x.7z", seven(FILES, *CODERS["lzma"], packed_header=True)), ("bad.rar", bytes(bad)), ("cut.7z", seven(FILES)[:-3]), ("cut.rar", rar5(FILES)[:30]), ("enc.7z", unknown)]
    found = archives.members(spark.createDataFrame(rows, "path string, content binary"), with_content=True)
    got = {(r.archive, r.inner): r for r in found.collect()}
    for a in ("x.zip", "x.rar", "old.rar", "x.7z"):
        for n, d in FILES:
            r = got[a, n]
            assert (r.file_size, r.crc, bytes(r.content), r.ok) == (len(d), zlib.crc32(d), d, True)
    assert "checksum" in got["bad.rar", "a.txt"].error and got["bad.rar", "empty"].ok
    assert got["cut.7z", None].error and got["cut.rar", None].error
    assert got["enc.7z", "a.txt"].file_size == 5 and "not supported" in got["enc.7z", "a.txt"].error
    some = archives.members(spark.createDataFrame(rows[:4], "path string, content binary"), pattern="png$")
    assert some.count() == 4 and all(r.content is None for r in some.collect())


NAMES = {
    "cp932": ["第一巻/表紙.jpg", "こんにちは世界.png", "アイドルの写真集 第二話.png", "ドラゴン上.zip"],
    "gb18030": ["第一卷/封面.jpg", "你好世界.png", "我们的故事 第二话.png", "中国人民大学.zip", "漫画汉化.png"],
    "big5": ["第一卷/封面.jpg", "你好世界.png", "我們的故事 第二話.png", "臺灣漫畫學會.zip"],
    "euc-kr": ["제일권/표지.jpg", "안녕하세요 세계.png", "우리의 이야기 이화.png", "대한민국 만화.zip"],
    "utf-8": ["第一巻/表紙.jpg", "제일권.png", "é.png"],
}


@pytest.mark.parametrize("encoding", NAMES)
def test_encoding_of_all_names_of_an_archive(spark, encoding):
    raw = [n.encode(encoding) for n in NAMES[encoding]]
    assert archives.detect_encoding([*raw, b"plain.txt"]) == encoding

    def info(name):
        i = zipfile.ZipInfo("x")
        i.filename, i.flag_bits = name.decode("cp437"), 0
        return i

    assert archives.member_names([info(r) for r in [*raw, b"plain.txt"]]) == [*NAMES[encoding], "plain.txt"]


def test_names_that_share_no_encoding():
    assert archives.detect_encoding([b"plain"]) is None and archives.detect_encoding([]) is None
    assert archives.decode_name(b"abc\xe9") == "abc" and archives.decode_name("日本".encode("cp932"), "utf-8") == "日本"


# rank profiles


def grams(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return Counter(text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1))


def top(counts):
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:300], 1)}


def test_profiles_one_text_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(language_profiles, "BLOCK", 50)
    monkeypatch.setattr(language_profiles, "COUNTED", 40)
    rows = [(1, "en", "The quick brown fox and the other thing " * 5), (2, "de", "Der schnelle Fuchs und das andere Ding über" * 4), (3, None, "the thing of the fox"), (4, "fr", None), (5, "en", ""), (None, "de", "Füchse und Dinge"), (7, "en", "ÀÉ Z"), (7, "en", "ÀÉ Z")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    known = {}
    for lang in ("en", "de"):
        known[lang] = top(sum((grams(t) for _, k, t in rows if k == lang), Counter()))
    got = language_profiles.profiles(docs)
    seen = {}
    for r in got.collect():
        seen.setdefault(r.lang, {})[r.gram] = r["rank"]
    assert seen == known
    out = sorted((tuple(r) for r in language_profiles.detect(docs, got).collect()), key=str)
    want = []
    for i, _, t in rows:
        own = top(grams(t))
        if not own:
            want.append((i, None, None, None, False))
            continue
        far = sorted((sum(abs(p[g] - r) if g in p else 300 for g, r in own.items()) / (len(own) * 300), k) for k, p in known.items())
        margin = (far[1][0] - far[0][0]) / far[1][0]
        want.append((i, far[0][1], far[0][0], margin, len(own) >= 20 and margin >= 0.05))
    assert out == sorted(want, key=str) and [w[1] for w in want[:3]] == ["en", "de", "en"]
    assert language_profiles.detect(docs.limit(0), got).count() == 0
    assert {r.lang for r in language_profiles.detect(docs, got.limit(0)).collect()} == {None}


# structure features


def test_features_part_by_part():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 256, (128, 128, 1), dtype=np.uint8)
    g = x[:, :, 0] / 255
    f = structure.features_of(x)
    assert len(f) == 222 and np.allclose(f[:5], [g.mean(), g.std(), np.median(g), g.min(), g.max()])
    blocks = [b for i in range(0, 128, 16) for j in range(0, 128, 16) for b in (g[i : i + 16, j : j + 16].mean(), g[i : i + 16, j : j + 16].std(), np.median(g[i : i + 16, j : j + 16]))]
    assert np.allclose(f[18:210], blocks)
    at = lambda y, z: g[min(max(y, 0), 127), min(max(z, 0), 127)]
    down = np.array([[sum(k * (at(y + 1, z + d) - at(y - 1, z + d)) for d, k in ((-1, 1), (0, 2), (1, 1))) / 4 for z in range(128)] for y in range(128)])
    across = np.array([[sum(k * (at(y + d, z + 1) - at(y + d, z - 1)) for d, k in ((-1, 1), (0, 2), (1, 1))) / 4 for z in range(128)] for y in range(128)])
    edge, size = np.sqrt((down**2 + across**2) / 2), np.sqrt(down**2 + across**2)
    assert np.allclose(f[5:8], [edge.mean(), edge.std(), (edge > 0.1).sum()])
    assert np.allclose(f[210:214], [size.mean(), size.std(), *np.percentile(size, [25, 75])])
    assert f[214:].sum() == 128 * 128 and f[8:18].sum() == 128 * 128
    # a flat picture: every point is as high as the centre but outside
    flat = structure.features_of(np.full((40, 60, 1), 100, np.uint8))
    assert flat[8 + 8] == 126 * 126 and flat[5] == 0


@pytest.mark.parametrize(("n", "p", "k"), [(200, 12, 5), (6, 12, 64), (50, 4, 64)])
def test_components_are_those_of_svd(spark, n, p, k):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + 1000
    x[:, 1] = 7  # constant
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None)], "id long, features array<double>").repartition(5)
    model = structure.fit(rows, k, groups=3)
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-9, 1, x.std(0))
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    m = min(k, n, p)
    assert len(model.directions) == m and np.allclose(model.explained[: len(s)], (s**2 / n)[:m], atol=1e-6)
    rank = int((s > 1e-6).sum())
    got = {r.id: r.hash_vector for r in structure.transform(rows, model).collect()}
    assert got[n] is None and all(len(got[i]) == m for i in range(n))
    want = z @ vt.T
    for c in range(min(m, rank)):
        mine = np.array([got[i][c] for i in range(n)])
        assert min(np.abs(mine - want[:, c]).max(), np.abs(mine + want[:, c]).max()) < 1e-5
    with pytest.raises(ValueError, match="no vectors"):
        structure.fit(rows.limit(0))


def test_features_of_files_and_changes(spark):
    x = np.random.default_rng(1).integers(0, 256, (30, 20, 3), dtype=np.uint8)
    rows = spark.createDataFrame([(1, images.png_bytes(x)), (2, b"none"), (3, None)], "id long, content binary")
    got = {r.id: r for r in structure.features(rows).collect()}
    assert np.allclose(got[1].features, structure.features_of(x)) and got[2].features is None and got[2].error and got[3].error
    key = lambda p, s, t: hashlib.md5(f"{p.rsplit('/', 1)[-1]}_{s}_{t}".encode()).hexdigest()[:16]
    files = spark.createDataFrame([("/a/x.png", 5, 7), ("/a/y.png", 5, 8), ("/a/z.png", 1, 1)], "path string, size long, mtime long")
    cache = spark.createDataFrame([("/a/x.png", key("/a/x.png", 5, 7)), ("/a/y.png", key("/a/y.png", 5, 7))], "path string, key string")
    assert sorted((r.path, r.key) for r in structure.changed(files, cache).collect()) == [(p, key(p, s, t)) for p, s, t in (("/a/y.png", 5, 8), ("/a/z.png", 1, 1))]
