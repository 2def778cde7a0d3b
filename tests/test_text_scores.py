"""The text scores' values on pictures whose scores follow from the rules of the reference."""

import numpy as np

from siftmill.functions import pixels


def page(lines, h=200, w=300):
    g = np.full((h, w), 255, np.uint8)
    for y, a, b in lines:
        g[y : y + 4, a:b] = 0
    return g


def bgr(g):
    return np.repeat(g[:, :, None], 3, axis=2)


def test_boxes_and_holes():
    m = np.zeros((30, 40), bool)
    m[2:20, 2:30] = True
    m[5:17, 5:27] = False  # a frame
    m[9:11, 9:20] = True  # within it: no external contour
    m[20, 30] = True  # touches the frame's corner
    m[25:27, 0:10] = True  # at the border
    assert sorted(pixels._outer_boxes(m)) == [(2, 19, 2, 29), (25, 2, 0, 10)]


def test_adaptive_threshold_is_local():
    g = np.full((40, 40), 100, np.uint8)
    g[:, 20:] = 200
    g[20, 30] = 190
    dark = pixels._adaptive_dark(g)
    assert dark[20, 30] and not dark[:, :14].any() and not dark[5, 30] and dark[5, 19]


def test_lines():
    even = [(y, 20, 280) for y in range(20, 170, 20)]
    n = len(even)
    assert pixels._text_lines(page(even)) == (1.0, n, 1.0, n * 6 / 200)
    columns = [(y, a, b) for y in range(20, 170, 20) for a, b in ((10, 130), (170, 290))]  # beside each other
    assert pixels._text_lines(page(columns))[:3] == (1.0, 2 * n, 1.0)
    assert pixels._text_lines(page(even[:2]))[:2] == (0.3, 2)
    assert pixels._text_lines(page([(20, 20, 280), (30, 20, 280), (150, 20, 280)]))[0] == 0.3  # uneven: gaps of 4 and 114
    assert pixels._text_lines(page([]))[:2] == (0.0, 0)


def test_edges_and_colours():
    stripes = bgr(page([(y, 0, 300) for y in range(10, 190, 8)]))
    assert pixels._edge_score(stripes[:, :, 0]) == 1.0 and pixels._edge_score(stripes[:, :, 0].T) == 0.0
    assert pixels._colour_score(stripes, stripes[:, :, 0]) == 1.0
    ramp = bgr(np.repeat(np.arange(120, 180, dtype=np.uint8)[None], 60, 0))
    assert pixels._colour_score(ramp, ramp[:, :, 0]) == 0.7
    combs = bgr(np.tile(np.repeat(np.arange(80, 170, 16, dtype=np.uint8), 10), (60, 1)))  # 6 peaks a channel, contrast 80 / 255
    assert pixels._colour_score(combs, combs[:, :, 0]) == 0.0


def test_frequency():
    wave = np.tile(np.rint(127 + 100 * np.cos(np.arange(60) * 2 * np.pi / 6)), (60, 1)).astype(np.uint8)
    assert pixels._frequency_score(wave) == 1.0 and pixels._frequency_score(wave.T) == 0.0
    assert pixels._frequency_score(np.full((60, 60), 9, np.uint8)) == 0.0
    rng = np.random.default_rng(2)
    assert pixels._frequency_score(rng.integers(0, 256, (60, 60), dtype=np.uint8)) == 0.0


def test_gates_and_total():
    even = bgr(page([(y, 20, 280) for y in range(20, 170, 20)]))
    got = pixels.text_scores_of(even)
    assert got["line_score"] == got["color_score"] == 1.0 and got["edge_score"] == 1.0
    assert abs(got["total"] - (0.8 + got["pattern_score"] + 0.8 + 1.4 + 0.5 * 8 * 6 / 200)) < 1e-9
    assert pixels.text_scores_of(even[:, :, :1]) == got
    red = even.copy()
    red[:, :, :2] //= 2  # coloured: nothing counts
    assert set(pixels.text_scores_of(red).values()) == {0.0}
    assert set(pixels.text_scores_of(bgr(page([]))).values()) == {0.0}  # no line: nothing counts


def test_block_scores_put_out_no_pairs(spark, monkeypatch):
    """Against all pairs, with parts of a few rows: null, zero, short and broken vectors, null labels and repeated ids count as there."""
    import random

    from pyspark.sql import functions as F

    from siftmill.functions import vectors
    from siftmill.operators import similarity

    monkeypatch.setattr(similarity, "SCORE_BLOCK", 7)
    monkeypatch.setattr(similarity, "SCORE_TILE", 3)
    rng = random.Random(1)
    rows = [(i // 2 if i % 9 == 1 else i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)]
    rows += [(100, None, 0), (101, [0.0] * 4, 0), (102, [1.0, None, 2.0, 3.0], 1), (103, [1.0, 2.0], 1), (104, [2.0, 1.0], 1), (105, [1.0] * 4, None), (106, [1.0] * 4, 7), (107, None, 8), (108, None, 8), (None, [1.0] * 4, 0)]
    e = spark.createDataFrame(rows, "id long, v array<float>, k int")
    pairs = similarity.vector_pairs(e.where("id IS NOT NULL"), "id", "v", "k")
    x, y = e.toDF("a", "av", "k"), e.toDF("b", "bv", "k")
    want = x.join(y, "k").where("a < b").groupBy("k").agg(F.count("*").alias("n"), F.avg(vectors.cosine(F.col("av"), F.col("bv"))).alias("s"), F.max(vectors.cosine(F.col("av"), F.col("bv"))).alias("m"))
    rounded = lambda d: sorted((r[0], r[1], *(None if q is None else round(q, 9) for q in r[2:])) for r in d.collect())
    got = similarity.block_scores(e, "id", "v", "k")
    assert rounded(got) == rounded(want) and sum(r.n_pairs for r in got.collect()) == pairs.count()


def test_grams_are_counted_as_numbers(monkeypatch):
    """The counts of a plain count, and numbers in the order of the n-grams, for characters of every width and NUL; arrays, not an object per n-gram."""
    from collections import Counter

    from siftmill.operators import language_profiles as p

    for block in (5, 1 << 20):
        monkeypatch.setattr(p, "BLOCK", block)
        for text in ("", "a", "ab", "abcab" * 9, "\0a\0\0b", "z\U0010ffff\u00e9\u6f22a z", "\uffff\U00010000" * 4):
            keys, n = p._grams(text)
            want = Counter(text[i : i + k] for k in (1, 2, 3) for i in range(len(text) - k + 1))
            assert isinstance(keys, np.ndarray) and [(p._gram(k), c) for k, c in zip(keys.tolist(), n.tolist(), strict=True)] == sorted(want.items())
            assert [p._number(g) for g in sorted(want)] == keys.tolist()
