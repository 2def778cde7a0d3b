"""Pixel measures as Arrow UDFs over decoded images.

Input is what Spark's image reader gives: height, width, channels and interleaved bytes (BGR order); `decoded` reads files so. Images are
processed one by one within a batch; a row that cannot be measured has null results.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplications of a strip of a product of matrices.
STRIP = 1 << 18


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data) of the image files under a folder that the JVM can decode; others are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def _array(h: int, w: int, c: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, c)


def _gray(x: np.ndarray) -> np.ndarray:
    """Luma of BGR(A) as floats."""
    if x.shape[2] == 1:
        return x[:, :, 0].astype(np.float64)
    b, g, r = (x[:, :, i].astype(np.float64) for i in range(3))
    return 0.299 * r + 0.587 * g + 0.114 * b


@lru_cache(maxsize=64)
def _area_weights(size: int, n: int) -> np.ndarray:
    """(n, size): shares of cells in an area average."""
    edges = np.linspace(0, size, n + 1)
    cells = np.arange(size)
    cover = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.clip(cover, 0, 1) / (size / n)


def _resize(x: np.ndarray, n: int, m: int | None = None) -> np.ndarray:
    """Area average to n x m, n x n without m."""
    return _area_weights(x.shape[0], n) @ x @ _area_weights(x.shape[1], m or n).T


def _luma_of_rgb(x: np.ndarray) -> np.ndarray:
    """8-bit luma of BGR(A), rounded as image libraries convert RGB to one channel."""
    if x.shape[2] == 1:
        return x[:, :, 0]
    b, g, r = (x[:, :, i].astype(np.int64) for i in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + (1 << 15)) >> 16).astype(np.uint8)


@lru_cache(maxsize=256)
def _lanczos_weights(size: int, n: int) -> np.ndarray:
    """(n, size) weights in 22-bit fixed point, as floats, of a windowed sinc three lobes wide, stretched where an image shrinks."""
    scale = size / n
    stretch = max(scale, 1.0)
    centre = (np.arange(n) + 0.5) * scale
    low = np.maximum((centre - 3 * stretch + 0.5).astype(np.int64), 0)
    high = np.minimum((centre + 3 * stretch + 0.5).astype(np.int64), size)
    row = np.repeat(np.arange(n), high - low)
    at = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - high, high - low)
    t = (at - centre[row] + 0.5) / stretch
    w = np.zeros((n, size))
    w[row, at] = np.where((t >= -3) & (t < 3), np.sinc(t) * np.sinc(t / 3), 0.0)
    w /= w.sum(1, keepdims=True)
    return np.trunc(w * (1 << 22) + np.where(w < 0, -0.5, 0.5))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b by strips of lines that are too small for BLAS to start threads for: tasks have taken all cores, and its threads would wait for each other."""
    n = max(2, STRIP // b.size)
    return a @ b if len(a) <= n else np.concatenate([a[i : i + n] @ b for i in range(0, len(a), n)])


def _lanczos(x: np.ndarray, n: int) -> np.ndarray:
    """An 8-bit image at n x n pixels: rows first, then columns, each rounded to 8 bits. Products are whole numbers far below 2**53, so floats are exact."""
    half = 1 << 21
    if x.shape[1] != n:
        x = np.clip((_product(x.astype(np.float64), _lanczos_weights(x.shape[1], n).T).astype(np.int64) + half) >> 22, 0, 255)
    if x.shape[0] != n:
        x = np.clip((_product(_lanczos_weights(x.shape[0], n), x.astype(np.float64)).astype(np.int64) + half) >> 22, 0, 255)
    return x


@lru_cache(maxsize=16)
def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def phash_of(x: np.ndarray, size: int = 10) -> str:
    """Perceptual hash as stored catalogs have it: 8-bit luma, Lanczos resampling to 4 * size pixels a side, DCT, the low size * size
    terms against their median, row by row, in hexadecimal."""
    n = 4 * size
    d = _dct(n)
    low = (2 * d @ _lanczos(_luma_of_rgb(x), n).astype(np.float64) @ (2 * d.T))[:size, :size]
    bits = (low > np.median(low)).ravel()
    digits = -(-len(bits) // 4)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{digits}x}"


def _sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if min(g.shape) < 2:
        p = np.pad(g, 1, mode="reflect")
    else:
        p = np.empty((g.shape[0] + 2, g.shape[1] + 2), g.dtype)
        p[1:-1, 1:-1], p[0, 1:-1], p[-1, 1:-1] = g, g[1], g[-2]
        p[:, 0], p[:, -1] = p[:, 2], p[:, -3]
    v = p[:-2] + 2 * p[1:-1] + p[2:]
    h = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return v[:, 2:] - v[:, :-2], h[2:] - h[:-2]


def sharpness_of(x: np.ndarray) -> int:
    """Mean of the squared Sobel gradient, rounded; 0 for images with a side under 2."""
    g = _gray(x)
    if min(g.shape) < 2:
        return 0
    gx, gy = _sobel(g)
    return int(round(float((gx**2 + gy**2).mean())))


def colour_stats_of(x: np.ndarray, std_limit: float = 800.0, diff: int = 30, share_limit: float = 0.2, white: int = 240, black: int = 20, white_share: float = 0.9) -> dict:
    """Grayscale, white and black flags with their measures. Channel differences are true ones, not modulo 256."""
    g = _gray(x)
    if x.shape[2] == 1:
        std, colour = 0.0, 0.0
    else:
        c = x[:, :, :3].astype(np.int16)
        std = float(np.std(c.var(axis=2)))
        colour = float((c.max(2) - c.min(2) > diff).mean())
    w, b = float((g >= white).mean()), float((g <= black).mean())
    top = x[:, :, :3].max(2) / 255.0 if x.shape[2] > 1 else np.zeros(g.shape)
    low = x[:, :, :3].min(2) / 255.0 if x.shape[2] > 1 else np.zeros(g.shape)
    saturation = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
    return {
        "is_grayscale": std <= std_limit and colour <= share_limit, "is_white_image": w >= white_share, "is_pure_white": w == 1.0, "is_pure_black": b == 1.0,
        "channel_std": std, "grayscale_score": (w + b) / 2, "white_score": w, "black_score": b, "colorfulness": float(saturation.mean()),
    }


def sampled_kind_of(x: np.ndarray, points: int = 100, white: int = 240, black: int = 15, diff: int = 5) -> str:
    """`white`, `black`, `gray` or `colour` by at most `points` pixels of an even grid."""
    side = int(points**0.5)
    rows = np.linspace(0, x.shape[0] - 1, min(side, x.shape[0])).astype(int)
    cols = np.linspace(0, x.shape[1] - 1, min(side, x.shape[1])).astype(int)
    p = x[np.ix_(rows, cols)][:, :, : min(3, x.shape[2])].astype(np.int16)
    if (p > white).all():
        return "white"
    if (p < black).all():
        return "black"
    return "gray" if (p.max(2) - p.min(2) < diff).all() else "colour"


def sampled_kind(height: Column, width: Column, channels: Column, data: Column) -> Column:
    return _image_udf(sampled_kind_of, "string")(height, width, channels, data)


def is_monochrome(score: Column, least: float = 0.85) -> Column:
    """By the score of an outside model, given as a column."""
    return F.coalesce(score >= least, F.lit(False))


COLOUR_STATS = "is_grayscale boolean, is_white_image boolean, is_pure_white boolean, is_pure_black boolean, channel_std double, grayscale_score double, white_score double, black_score double, colorfulness double"


def ssim_of(x: np.ndarray, y: np.ndarray, side: int | None = None) -> float:
    """Structural similarity of luma, Gaussian window 11, sigma 1.5.

    At the images' own size, or the smaller height and width of the two, with zeros around (P63); with `side` at
    side * side pixels and without an edge (V15 with 128).
    """
    a, b = _gray(x) / 255, _gray(y) / 255
    if side is not None:
        a, b = _resize(a, side), _resize(b, side)
    else:
        if a.shape != b.shape:
            h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
            a, b = _resize(a, h, w), _resize(b, h, w)
        a, b = np.pad(a, 5), np.pad(b, 5)
    k = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    k /= k.sum()

    def blur(z: np.ndarray) -> np.ndarray:
        z = np.apply_along_axis(np.convolve, 0, z, k, "valid")
        return np.apply_along_axis(np.convolve, 1, z, k, "valid")

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    c1, c2 = 0.01**2, 0.03**2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def _luma8(x: np.ndarray) -> np.ndarray:
    """8-bit luma of BGR, in the usual fixed-point weights."""
    b, g, r = (x[:, :, i].astype(np.int64) for i in range(3))
    return ((3735 * b + 19235 * g + 9798 * r + (1 << 14)) >> 15).astype(np.uint8)


def _adaptive_dark(g: np.ndarray, block: int = 11, c: int = 2) -> np.ndarray:
    """Pixels at least `c` below the Gaussian mean of their block; edges are replicated."""
    half = block // 2
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(block) - half) ** 2) / (2 * sigma**2))
    k /= k.sum()
    h, w = g.shape
    p = np.pad(g.astype(np.float64), half, mode="edge")
    rows = sum(k[i] * p[i : i + h] for i in range(block))
    mean = np.rint(sum(k[i] * rows[:, i : i + w] for i in range(block)))
    return g.astype(np.int64) - mean <= -c


def _spread(m: np.ndarray, n: int) -> np.ndarray:
    """Each pixel or any of the (n - 1) // 2 above and below it, by unions of twice the length."""
    h, half = len(m), n // 2
    p = np.zeros((h + 2 * half, *m.shape[1:]), bool)
    p[half : half + h] = m
    size = 1
    while size * 2 <= n:
        p = p[:-size] | p[size:]
        size *= 2
    return p[:h] | p[n - size : n - size + h]


def _dilate(m: np.ndarray, rows: int, cols: int) -> np.ndarray:
    return _spread(_spread(m, rows).T, cols).T


def _labels(m: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """(runs (row, start, end), component of each run) of the set pixels, by runs of rows."""
    d = np.diff(np.pad(m, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (r, s), e = np.nonzero(d == 1), np.nonzero(d == -1)[1]
    runs = np.stack([r, s, e], 1)
    root = list(range(len(r)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first, s, e = np.searchsorted(r, np.arange(m.shape[0] + 1)).tolist(), s.tolist(), e.tolist()
    reach = 1 if diagonal else 0
    for y in range(1, m.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if s[i] < e[j] + reach and s[j] < e[i] + reach:
                x, z = find(i), find(j)
                root[max(x, z)] = min(x, z)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    return runs, np.array([find(i) for i in range(len(root))], np.int64)


def _outer_boxes(m: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(y, h, x, w) of 8-connected regions that lie in no hole of another, as external contours are."""
    p = np.pad(m, 1)
    back, of = _labels(~p, False)
    edge = np.zeros((p.shape[0], p.shape[1] + 1), np.int8)
    y, a, b = back[of == of[0]].T  # the padding is the first run
    edge[y, a], edge[y, b] = 1, -1
    outside = np.cumsum(edge, axis=1, dtype=np.int8)[:, :-1] > 0
    runs, of = _labels(p, True)
    near = _dilate(outside, 3, 1) | _dilate(outside, 1, 3)
    if not len(runs):
        return []
    y, a, b = runs[np.argsort(of, kind="stable")].T
    start = np.flatnonzero(np.diff(np.sort(of), prepend=-1))
    met = np.pad(np.cumsum(near, axis=1), ((0, 0), (1, 0)))
    seen = np.logical_or.reduceat(met[y, b] > met[y, a], start)
    top, left = np.minimum.reduceat(y, start), np.minimum.reduceat(a, start)
    boxes = np.stack([top - 1, np.maximum.reduceat(y, start) - top + 1, left - 1, np.maximum.reduceat(b, start) - left], 1)
    return [tuple(x) for x in boxes[seen].tolist()]


def _text_lines(g: np.ndarray) -> tuple[float, int, float, float]:
    """(score, lines, uniformity, coverage): wide and low regions of joined dark pixels, and how even their gaps are."""
    height, width = g.shape
    boxes = _outer_boxes(_dilate(_adaptive_dark(g), 3, 15))
    lines = sorted(((y, h) for y, h, _, w in boxes if w * h > height * width * 0.0005 and w / h > 2.5 and h < height * 0.1), key=lambda b: b[0])
    n, uniform, coverage = len(lines), 0.0, 0.0
    if n >= 3:
        gaps = [q[0] - p[0] - p[1] for p, q in zip(lines, lines[1:], strict=False)]
        gaps = np.array([x for x in gaps if x > 0], float)
        coverage = sum(h for _, h in lines) / height
        if len(gaps):
            uniform = 1 - min(1.0, float(gaps.var() / gaps.mean() ** 2))
    return (1.0 if n >= 5 and uniform > 0.7 else 0.7 if n >= 3 and uniform > 0.5 else 0.3 if n >= 2 else 0.0), n, uniform, coverage


def _frequency_score(g: np.ndarray) -> float:
    """By the ratio of peaks of the 2-D spectrum's horizontal and vertical profiles."""
    h, w = g.shape
    m = 20 * np.log(np.abs(np.fft.fftshift(np.fft.fft2(g))) + 1)
    low, high = m.min(), m.max()
    m = np.rint((m - low) * (255 / (high - low))) if high - low > np.finfo(float).eps else np.zeros_like(m)
    across = m[h // 2 - h // 6 : h // 2 + h // 6].sum(0)
    down = m[:, w // 2 - w // 6 : w // 2 + w // 6].sum(1)
    ratio = (across > across.mean() * 1.5).sum() / max(1, (down > down.mean() * 1.5).sum())
    return 1.0 if ratio > 1.8 else 0.7 if ratio > 1.4 else 0.3 if ratio > 1.1 else 0.0


def _edge_score(g: np.ndarray) -> float:
    """By the ratio of strong gradients that point up or down to those that point right, and their density."""
    gx, gy = _sobel(g.astype(np.float64))
    size, angle = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx))
    strong = size > size.mean() * 1.2
    horizontal = int(((np.abs(angle) < 20) & strong).sum())
    vertical = int(((np.abs(angle) > 70) & (np.abs(angle) < 110) & strong).sum())
    ratio, density = vertical / max(1, horizontal), (vertical + horizontal) / g.size
    return 1.0 if ratio > 1.8 and density > 0.05 else 0.7 if ratio > 1.5 and density > 0.03 else 0.3 if ratio > 1.2 else 0.0


def _colour_score(x: np.ndarray, g: np.ndarray) -> float:
    """By the number of histogram peaks of the channels and the contrast of the luma."""
    peaks = 0
    for i in range(3):
        h = np.bincount(x[:, :, i].ravel() // 8, minlength=32).astype(np.float32)
        h = (h - h.min()) / (h.max() - h.min()) if h.max() > h.min() else np.zeros(32)
        peaks += int(((h[1:-1] > 0.3) & (h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])).sum())
    contrast = (int(g.max()) - int(g.min())) / 255
    return 1.0 if peaks < 8 and contrast > 0.5 else 0.7 if peaks < 12 or contrast > 0.4 else 0.3 if peaks < 16 else 0.0


def text_scores_of(x: np.ndarray, kind: dict | None = None) -> dict:
    """Scores of how much an image looks like a page of text: lines, periodicity, edges, colours, and their weighted total; `kind` is its colour_stats_of, if known.

    All are 0 for an image that is not grayscale, white or black, or that has no lines. One channel counts as three equal ones.
    """
    none = dict.fromkeys(("line_score", "pattern_score", "edge_score", "color_score", "total"), 0.0)
    kind = kind or colour_stats_of(x)
    if not any(kind[k] for k in ("is_grayscale", "is_white_image", "is_pure_white", "is_pure_black")):
        return none
    x = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, :3]
    g = _luma8(x)
    line, n, uniform, coverage = _text_lines(g)
    if line == 0:
        return none
    pattern, edges, colour = _frequency_score(g), _edge_score(g), _colour_score(x, g)
    bonus = min(0.4, coverage * 0.5) if n >= 2 and uniform > 0.6 else 0.0
    return {"line_score": line, "pattern_score": pattern, "edge_score": edges, "color_score": colour, "total": 0.8 * line + pattern + 0.8 * edges + 1.4 * colour + bonus}


TEXT_SCORES = "line_score double, pattern_score double, edge_score double, color_score double, total double"


def structure_vector_of(x: np.ndarray, grid: int = 4, bins: int = 8) -> list[float]:
    """Statistics, gradients, local binary patterns, block means and gradient directions as one vector."""
    g = _resize(_gray(x), 64)
    gx, gy = _sobel(g)
    size = np.hypot(gx, gy)
    p = np.pad(g, 1, mode="reflect")
    lbp = np.zeros(g.shape, int)
    for i, (dy, dx) in enumerate([(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]):
        lbp |= (p[dy : dy + 64, dx : dx + 64] >= g).astype(int) << i
    angle = np.histogram(np.arctan2(gy, gx), bins=bins, range=(-np.pi, np.pi), weights=size)[0]
    blocks = g.reshape(grid, 64 // grid, grid, 64 // grid)
    parts = [[g.mean(), g.std(), g.min(), g.max(), size.mean(), size.std()], np.histogram(lbp, bins=16, range=(0, 256))[0] / g.size, blocks.mean((1, 3)).ravel(), blocks.std((1, 3)).ravel(), angle / (angle.sum() + 1e-9)]
    return [float(v) for v in np.concatenate(parts)]


def _image_udf(one, kind: str, is_struct: bool = False):
    @F.pandas_udf(kind)
    def run(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for h, w, c, d in zip(height, width, channels, data, strict=True):
            try:
                out.append(one(_array(int(h), int(w), int(c), d)))
            except (ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    @F.pandas_udf(kind)
    def run_struct(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in kind.split(", ")]
        out = []
        for h, w, c, d in zip(height, width, channels, data, strict=True):
            try:
                out.append(one(_array(int(h), int(w), int(c), d)))
            except (ValueError, TypeError):
                out.append(dict.fromkeys(names))
        return pd.DataFrame(out, columns=names)

    f = run_struct if is_struct else run
    return lambda h, w, c, d: f(h, w, c, d)


def phash(height: Column, width: Column, channels: Column, data: Column, size: int = 10) -> Column:
    return _image_udf(lambda x: phash_of(x, size), "string")(height, width, channels, data)


def sharpness(height: Column, width: Column, channels: Column, data: Column) -> Column:
    return _image_udf(sharpness_of, "long")(height, width, channels, data)


def colour_stats(height: Column, width: Column, channels: Column, data: Column) -> Column:
    return _image_udf(colour_stats_of, COLOUR_STATS, True)(height, width, channels, data)


def text_scores(height: Column, width: Column, channels: Column, data: Column) -> Column:
    return _image_udf(text_scores_of, TEXT_SCORES, True)(height, width, channels, data)


def structure_vector(height: Column, width: Column, channels: Column, data: Column) -> Column:
    return _image_udf(structure_vector_of, "array<double>")(height, width, channels, data)


def image_size_of(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, BMP, JPEG or WebP file; null for anything else."""
    d = data or b""
    if d[:8] == b"\x89PNG\r\n\x1a\n" and len(d) >= 24:
        return struct.unpack(">II", d[16:24])
    if d[:6] in (b"GIF87a", b"GIF89a") and len(d) >= 10:
        return struct.unpack("<HH", d[6:10])
    if d[:2] == b"BM" and len(d) >= 26:
        w, h = struct.unpack("<ii", d[18:26])
        return w, abs(h)
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP" and len(d) >= 30:
        kind = d[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(d[24:27], "little"), 1 + int.from_bytes(d[27:30], "little")
        if kind == b"VP8L":
            b = int.from_bytes(d[21:25], "little")
            return (b & 0x3FFF) + 1, (b >> 14 & 0x3FFF) + 1
        return struct.unpack("<HH", d[26:30])[0] & 0x3FFF, struct.unpack("<HH", d[26:30])[1] & 0x3FFF
    if d[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(d) and d[at] == 0xFF:
            mark, n = d[at + 1], int.from_bytes(d[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", d[at + 5 : at + 9])
                return w, h
            at += 2 + n
    return None


def image_size(content: Column) -> Column:
    """struct<width, height> of encoded images."""

    @F.pandas_udf("width int, height int")
    def run(data: pd.Series) -> pd.DataFrame:
        got = [image_size_of(c) or (None, None) for c in data]
        return pd.DataFrame(got, columns=["width", "height"]).astype("Int32")

    return run(content)
