import numpy as np
from pyspark.sql import functions as F

from siftmill.functions import pixels
from siftmill.streaming import ingest


def test_measures():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (64, 48, 3), dtype=np.uint8)
    assert len(pixels.phash_of(x)) == 25 and pixels.phash_of(x) == pixels.phash_of(x)
    assert pixels.sharpness_of(np.full((8, 8, 3), 7, np.uint8)) == 0 < pixels.sharpness_of(x)
    white = pixels.colour_stats_of(np.full((8, 8, 3), 255, np.uint8))
    assert white["is_pure_white"] and white["is_grayscale"] and not white["is_pure_black"]
    assert not pixels.colour_stats_of(np.dstack([np.full((8, 8), v, np.uint8) for v in (0, 0, 255)]))["is_grayscale"]
    assert abs(pixels.ssim_of(x, x) - 1) < 1e-9 > pixels.ssim_of(x, 255 - x) - 1
    assert pixels.image_size_of(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (5).to_bytes(4, "big") + (7).to_bytes(4, "big")) == (5, 7)
    assert pixels.sampled_kind_of(np.full((8, 8, 3), 255, np.uint8)) == "white"
    assert pixels.sampled_kind_of(np.zeros((8, 8, 3), np.uint8)) == "black"
    assert pixels.sampled_kind_of(np.full((8, 8, 3), 100, np.uint8)) == "gray"
    assert pixels.sampled_kind_of(x) == "colour"
    assert pixels.image_size_of(b"nothing") is None


def test_udfs(spark):
    x = spark.createDataFrame([(3, 3, 1, bytes([0, 0, 255] * 3)), (2, 2, 1, b"short")], "h int, w int, c int, d binary")
    got = x.select(pixels.sharpness(*map(F.col, "hwcd")).alias("s"), pixels.colour_stats(*map(F.col, "hwcd")).alias("k")).collect()
    assert got[0].s > 0 and got[1].s is None and got[1].k.white_score is None


def test_stream(spark, tmp_path):
    for i, h in enumerate(("aaaa", "bbbb")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.json").write_text(f'{{"uri": "/a/x.jpg", "hash_value": "{h}", "calculated_time": {i}}}\n')
        s = ingest.read_records(spark, str(tmp_path / "in"), "uri string, hash_value string, calculated_time double")
        ingest.append_catalog(s, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert [r.hash_value for r in ingest.current(spark, str(tmp_path / "out")).collect()] == ["bbbb"]


def test_lanczos_pixel_by_pixel():
    """The resampling against its definition, one pixel at a time."""
    import math

    rng = np.random.default_rng(6)
    for h, w, n in ((50, 33, 12), (7, 9, 16), (16, 40, 16), (16, 16, 16)):
        x = rng.integers(0, 256, (h, w)).astype(np.uint8)

        def line(values, n=n):
            size = len(values)
            if size == n:
                return [int(v) for v in values]
            scale = size / n
            f, out = max(scale, 1.0), []
            for i in range(n):
                c = (i + 0.5) * scale
                lo, hi = max(int(c - 3 * f + 0.5), 0), min(int(c + 3 * f + 0.5), size)
                ts = [(j - c + 0.5) / f for j in range(lo, hi)]
                ws = [0.0 if not -3 <= t < 3 else 1.0 if t == 0 else math.sin(t * math.pi) / (t * math.pi) * math.sin(t * math.pi / 3) / (t * math.pi / 3) for t in ts]
                fixed = [int(q / sum(ws) * (1 << 22) + (0.5 if q >= 0 else -0.5)) for q in ws]
                out.append(min(max((sum(k * int(v) for k, v in zip(fixed, values[lo:hi], strict=True)) + (1 << 21)) >> 22, 0), 255))
            return out

        rows = [line(r) for r in x]
        want = np.array([line(c) for c in zip(*rows, strict=True)]).T
        assert np.abs(pixels._lanczos(x, n).astype(int) - want).max() <= 1  # a weight may round the other way
        assert (pixels._lanczos(x, n) == want).mean() > 0.99
