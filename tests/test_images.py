"""Images from archives' bytes: decoders against an encoder of their own and literal files, the ladder of readers, measures and decisions."""

import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.functions import images, pixels
from siftmill.media_queries import QUERIES
from siftmill.plans import workflows
from siftmill.sources import archives

PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def scan(rows, bits, rnd):
    """Filtered scan lines of rows of sample lists, one sample after the other."""
    out, up = b"", None
    for row in rows:
        packed = "".join(f"{v:0{bits}b}" for v in row)
        line = [int(packed[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(packed), 8)]
        up = up or [0] * len(line)
        kind, step = rnd.randrange(5), STEP[0]
        got = []
        for i, v in enumerate(line):
            a, c = (line[i - step], up[i - step]) if i >= step else (0, 0)
            got.append((v - [0, a, up[i], (a + up[i]) // 2, paeth(a, up[i], c)][kind]) & 255)
        out, up = out + bytes([kind, *got]), line
    return out


STEP = [1]


def encode(x, bits, colour, interlaced, rnd, extra=b""):
    """A PNG of samples (h, w, n) as nested lists."""
    h, w, n = len(x), len(x[0]), len(x[0][0])
    STEP[0] = max(1, n * bits // 8)
    flat = lambda y0, x0, sy, sx: [[v for p in row[x0::sx] for v in p] for row in x[y0::sy]]
    parts = [scan(flat(y0, x0, sy, sx), bits, rnd) for x0, y0, sx, sy in PASSES if x0 < w and y0 < h] if interlaced else [scan(flat(0, 0, 1, 1), bits, rnd)]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body = zlib.compress(b"".join(parts))
    cut = len(body) // 2
    return images.PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, interlaced)) + extra + chunk(b"IDAT", body[:cut]) + chunk(b"IDAT", body[cut:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [0, 1])
@pytest.mark.parametrize(("colour", "n", "bits"), [(0, 1, 1), (0, 1, 2), (0, 1, 4), (0, 1, 8), (0, 1, 16), (2, 3, 8), (2, 3, 16), (4, 2, 8), (4, 2, 16), (6, 4, 8), (6, 4, 16)])
def test_png_of_every_kind(colour, n, bits, interlaced):
    rnd = random.Random(colour * 100 + bits)
    for h, w in ((1, 1), (5, 3), (11, 17)):
        x = [[[rnd.randrange(1 << bits) for _ in range(n)] for _ in range(w)] for _ in range(h)]
        got = images.png_pixels(encode(x, bits, colour, interlaced, rnd)).tolist()
        eight = lambda v: v >> 8 if bits == 16 else v if bits == 8 else v * 255 // ((1 << bits) - 1)
        order = {0: [0], 2: [2, 1, 0], 4: [0, 0, 0, 1], 6: [2, 1, 0, 3]}[colour]
        assert got == [[[eight(p[k]) for k in order] for p in row] for row in x]


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_png_with_a_palette(bits):
    rnd = random.Random(bits)
    colours = [[rnd.randrange(256) for _ in range(3)] for _ in range(1 << bits)]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    plte = chunk(b"PLTE", bytes(v for c in colours for v in c))
    x = [[[rnd.randrange(1 << bits)] for _ in range(9)] for _ in range(7)]
    assert images.png_pixels(encode(x, bits, 3, 0, rnd, plte)).tolist() == [[colours[p[0]][::-1] for p in row] for row in x]
    got = images.png_pixels(encode(x, bits, 3, 1, rnd, plte + chunk(b"tRNS", bytes([7])))).tolist()
    assert got == [[[*colours[p[0]][::-1], 7 if p[0] == 0 else 255] for p in row] for row in x]
    assert images.pixels_of(encode(x, bits, 3, 0, rnd))[0] is None  # no palette


def test_literal_bitmap():
    head = bytes.fromhex("424d4600000000000000360000002800000002000000020000000100180000000000100000000000000000000000000000000000000000")[:54].ljust(54, b"\0")
    bmp = head + bytes.fromhex("ff0000ffffff00000000ff00ff000000")  # the lower line first
    assert images.bmp_pixels(bmp).tolist() == [[[0, 0, 255], [0, 255, 0]], [[255, 0, 0], [255, 255, 255]]]


def test_pixels_are_those_of_the_jvm_reader(spark, tmp_path):
    """Files of this module, and of the encoder above, as Spark's image reader sees them."""
    rnd, rng = random.Random(9), np.random.default_rng(9)
    (tmp_path / "i").mkdir()
    for k, c in enumerate((1, 3, 4)):
        (tmp_path / f"i/own{k}.png").write_bytes(images.png_bytes(rng.integers(0, 256, (7, 5, c), dtype=np.uint8)))
    (tmp_path / "i/own.bmp").write_bytes(images.bmp_bytes(rng.integers(0, 256, (7, 5, 3), dtype=np.uint8)))
    for colour, n in ((0, 1), (2, 3), (6, 4)):
        for interlaced in (0, 1):
            x = [[[rnd.randrange(256) for _ in range(n)] for _ in range(11)] for _ in range(13)]
            (tmp_path / f"i/e{colour}{interlaced}.png").write_bytes(encode(x, 8, colour, interlaced, rnd))
    got = {r.path.rsplit("/", 1)[1]: (r.height, r.width, r.channels, bytes(r.data)) for r in pixels.decoded(spark, str(tmp_path / "i")).collect()}
    assert len(got) == 10
    files = spark.read.format("binaryFile").load(str(tmp_path / "i")).select("path", "content")
    for r in images.decoded(files).collect():
        assert (r.height, r.width, r.channels, bytes(r.data)) == got[r.path.rsplit("/", 1)[1]] and r.reader == "verified"


def test_bmp_of_every_kind():
    rnd = np.random.default_rng(3)
    for h, w in ((1, 1), (4, 5), (3, 16)):
        x = rnd.integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert (images.bmp_pixels(images.bmp_bytes(x)) == x).all()
        wide = np.dstack([x, np.zeros((h, w, 1), np.uint8)])
        head = lambda hh, depth, start, used=0: struct.pack("<2sIIIIiiHHIIiiII", b"BM", 0, 0, start, 40, w, hh, 1, depth, 0, 0, 0, 0, used, 0)  # noqa: E731,B023
        assert (images.bmp_pixels(head(-h, 32, 54) + wide.tobytes()) == x).all()  # lines from the top
        for depth in (1, 4, 8):
            colours = rnd.integers(0, 256, (1 << depth, 4), dtype=np.uint8)
            index = rnd.integers(0, 1 << depth, (h, w))
            lines = b""
            for row in index[::-1]:
                packed = "".join(f"{v:0{depth}b}" for v in row)
                lines += bytes(int(packed[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(packed), 8)).ljust(-(-w * depth // 32) * 4, b"\0")
            assert (images.bmp_pixels(head(h, depth, 54 + 4 * len(colours)) + colours.tobytes() + lines) == colours[index][:, :, :3]).all()


def test_ladder():
    x = np.random.default_rng(1).integers(0, 256, (40, 30, 3), dtype=np.uint8)
    png, bmp = images.png_bytes(x), images.bmp_bytes(x)
    for good in (png, bmp):
        assert images.pixels_of(good)[1] == "verified" and (images.pixels_of(good)[0] == x).all()
    broken = png[:-1] + b"\0"
    assert images.pixels_of(broken)[1] == "unchecked" and (images.pixels_of(broken)[0] == x).all()
    got, reader, _ = images.pixels_of(png[: len(png) * 2 // 3])
    assert reader == "unchecked" and got.shape == x.shape and (got[:10] == x[:10]).all() and not got[-1].any()
    got, reader, _ = images.pixels_of(bmp[:-200])
    assert reader == "unchecked" and (got[10:] == x[10:]).all()
    for bad in (None, b"", b"text", png[:20], b"BM" + bytes(10), b"\xff\xd8\xff\xe0 jpeg"):
        got, reader, error = images.pixels_of(bad)
        assert got is None and reader is None and error
    huge = png[:16] + struct.pack(">II", 1 << 20, 1 << 20) + png[24:]
    assert "pixels are more than" in images.pixels_of(huge)[2]


@pytest.fixture(scope="module")
def files(spark):
    rng = np.random.default_rng(5)
    xs = {"p1.png": rng.integers(0, 256, (20, 24, 3), dtype=np.uint8), "in/p2.BMP": rng.integers(0, 256, (33, 16, 3), dtype=np.uint8), "p3.png": np.full((12, 30, 1), 255, np.uint8), "p4.png": np.repeat(rng.integers(0, 200, (9, 50, 1), dtype=np.uint8), 3, 2)}
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, x in xs.items():
            z.writestr(n, images.bmp_bytes(x) if n.endswith("BMP") else images.png_bytes(x))
        z.writestr("broken.png", b"nothing")
        z.writestr("empty.jpg", b"")
        z.writestr("notes.txt", b"text")
    none = io.BytesIO()
    with zipfile.ZipFile(none, "w") as z:
        z.writestr("notes.txt", b"text")
    rows = [("/a/x.zip", b.getvalue(), 1), ("/a/none.zip", none.getvalue(), 2), ("/a/bad.zip", b"no archive", 3), ("/a/null.zip", None, 4)]
    return spark.createDataFrame(rows, "path string, content binary, width int"), xs


def test_measures_of_members(files):
    rows = {r.inner: r for r in workflows.archive_images(files[0]).where("archive = '/a/x.zip'").collect()}
    assert set(rows) == {*files[1], "broken.png", "empty.jpg"}
    for n, x in files[1].items():
        r = rows[n]
        assert (r.height, r.width, r.channels) == x.shape and r.uri == f"archive:////a/x.zip!{n}" and r.error is None
        colour = pixels.colour_stats_of(x)
        assert r.phash == pixels.phash_of(x) and r.sharpness == pixels.sharpness_of(x) and r.text_total == pixels.text_scores_of(x)["total"]
        assert all(r[k] == colour[k] for k in colour if k in r.__fields__)
    assert rows["p3.png"].is_pure_white and rows["broken.png"].error and rows["empty.jpg"].error == "no bytes"
    bad = workflows.archive_images(files[0]).where("archive in ('/a/bad.zip', '/a/null.zip')").collect()
    assert len(bad) == 2 and all(r.inner is None and r.error for r in bad)


def test_metric_bundle(files):
    got = {r.archive: r for r in workflows.archive_metrics(files[0], sample=6).collect()}
    assert set(got) == {"/a/x.zip", "/a/none.zip", "/a/bad.zip", "/a/null.zip"}
    assert all((got[a].width, got[a].page_count, got[a].clarity) == (0, 0, 0.0) for a in got if a != "/a/x.zip")
    x = got["/a/x.zip"]
    # by file size: p2, p1, p4, p3, broken, empty; of them the first, the fourth, and the rest of the largest three
    sampled = [files[1][n] for n in ("in/p2.BMP", "p1.png", "p4.png", "p3.png")]
    sharp = [s for s in map(pixels.sharpness_of, sampled) if s > 0]
    assert x.page_count == 6 and x.width == sorted(s.shape[1] for s in sampled)[2] and abs(x.clarity - sum(sharp) / len(sharp)) < 1e-9


def test_pack_and_read_again(spark):
    rows = [("a.zip", "2", b"two"), ("a.zip", "1", None), ("b.zip", "x/y", b"y"), (None, "z", b""), ("c.zip", None, b"")]
    packed = archives.pack(spark.createDataFrame(rows, "archive string, inner string, content binary"))
    got = sorted((r.archive, r.inner, bytes(r.content), r.ok) for r in archives.members(packed, with_content=True).collect())
    assert got == [("a.zip", "1", b"", True), ("a.zip", "2", b"two", True), ("b.zip", "x/y", b"y", True)]
    some = packed.withColumn("names", F.array(F.lit("2"), F.lit("none")))
    assert [r.inner for r in archives.members(some, names_col="names").collect()] == ["2"]


def test_decisions_from_bytes(spark, tmp_path):
    """The whole way on made texts: the cascade's decisions recomputed one picture at a time."""
    rnd = random.Random(4)
    texts = {i: "".join(rnd.choice("ab \n") for _ in range(rnd.choice([40, 900, 2500]))) for i in range(60)}
    texts |= {60: None, 61: texts[3], 62: texts[5], 64: texts[12], 66: texts[12]}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.item_id: (r.stage, r.reason) for r in QUERIES["archive_decisions"](spark, str(tmp_path)).collect()}
    want, left = {}, {}
    for i, t in texts.items():
        raw = (t or "").encode()
        h, odd = max(1, -(-len(raw) // 48)), i % 2
        x = np.frombuffer(raw.ljust(h * 48, b"\0"), np.uint8).reshape((h, 16, 3) if odd else (h, 48, 1))
        uri = f"archive:///a{i // 40}.zip!{i}.{'bmp' if odd else 'png'}"
        if i % 50 == 11:
            want[uri] = ("unreadable", "unreadable")
        elif h < 10:
            want[uri] = ("small_image", f"{h} lines")
        elif (total := pixels.text_scores_of(x)["total"]) >= 2:
            want[uri] = ("text_image", f"text score {total:.2f}")
        else:
            size = len(images.bmp_bytes(x) if odd else images.png_bytes(x))
            left.setdefault(pixels.phash_of(x), []).append((-size, uri))
    for group in left.values():
        group.sort()
        want |= {u: ("size", f"{s - group[0][0]} smaller") for s, u in group[1:]}
    assert got == want and {s for s, _ in want.values()} >= {"unreadable", "small_image", "size"}


def test_batches_end_by_the_size_of_pictures_and_features(monkeypatch):
    """However many rows a batch brings: one of many pictures, or of many arrays of features, is not held whole."""
    import pyarrow as pa

    from siftmill import media_queries

    monkeypatch.setattr(images, "BATCH_BYTES", 4000)
    texts = pa.record_batch({"doc_id": pa.array(range(50)), "text": pa.array(["x" * 1000] * 50)})
    got = list(media_queries.drawn(iter([texts]), lambda i, raw: (f"a{i}", f"{i}", raw, i)))
    assert [b.num_rows for b in got] == [4] * 12 + [2] and pa.Table.from_batches(got)["doc_id"].to_pylist() == list(range(50))
    out = [("features", "array<double>", pa.list_(pa.float64())), ("error", "string", pa.string())]
    rows = pa.record_batch({"id": pa.array(range(50)), "content": pa.array([b"x"] * 50)})
    made = list(images.results(iter([rows]), "content", ["id"], out, lambda c: (np.arange(222.0), None)))
    assert max(b.num_rows for b in made) == 3 and pa.Table.from_batches(made)["id"].to_pylist() == list(range(50))
    assert made[-1].column("features")[0].as_py() == list(range(222))
