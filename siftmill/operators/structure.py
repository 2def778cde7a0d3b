"""Structure features of pictures, standardised and reduced by principal components that Spark sums up."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.functions import pixels

SIDE, BLOCK = 128, 16


#: What the eight bits of a local pattern count as: their ones, if they change at most twice around; else 9.
_PATTERN = np.array([sum(b) if sum(b[i] != b[i - 1] for i in range(8)) <= 2 else 9 for b in ([n >> k & 1 for k in range(8)] for n in range(256))], np.uint8)


def _edges(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences down and across, smoothed by 1 2 1; edges are mirrored."""
    p = np.empty((g.shape[0] + 2, g.shape[1] + 2))
    p[1:-1, 1:-1], p[0, 1:-1], p[-1, 1:-1] = g, g[0], g[-1]
    p[:, 0], p[:, -1] = p[:, 1], p[:, -2]

    def smooth(low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = 2 * middle
        out += low
        out += high
        out /= 4
        return out

    down, across = p[2:] - p[:-2], p[:, 2:] - p[:, :-2]
    return smooth(down[:, :-2], down[:, 1:-1], down[:, 2:]), smooth(across[:-2], across[1:-1], across[2:])


def _uniform_patterns(g: np.ndarray) -> np.ndarray:
    """Local binary patterns of eight points on a circle of radius 1: the number of points not below the centre, if they change at most twice around; else 9."""
    h, w = g.shape
    p = np.zeros((h + 4, w + 4))
    p[2:-2, 2:-2] = g
    code, beside = np.zeros((h, w), np.uint8), {}
    for k in range(8):
        y, x = -np.sin(2 * np.pi * k / 8), np.cos(2 * np.pi * k / 8)
        y, x = round(float(y), 5), round(float(x), 5)
        y0, x0 = int(np.floor(y)), int(np.floor(x))
        fy, fx = y - y0, x - x0
        # two points on each side share what lies between two columns; a point on a pixel is that pixel
        if x not in beside:
            at = p[:, 2 + x0 : 2 + x0 + w]
            beside[x] = (1 - fx) * at + fx * p[:, 3 + x0 : 3 + x0 + w] if fx else at
        point = beside[x][2 + y0 : 2 + y0 + h]
        if fy:
            point = (1 - fy) * point
            point += fy * beside[x][3 + y0 : 3 + y0 + h]
        code |= (point >= g).view(np.uint8) << np.uint8(k)
    return _PATTERN[code]


def _quantile(ordered: np.ndarray, q: float) -> np.ndarray:
    """Quantiles of lines in order, linear between two values."""
    i, t = divmod(q * (ordered.shape[-1] - 1), 1)
    a, b = ordered[..., int(i)], ordered[..., int(i) + 1]
    return (a + b) / 2 if t == 0.5 else a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)


def _gradients(down: np.ndarray, across: np.ndarray) -> tuple[list[float], list[float]]:
    """Mean, deviation and number of edges; mean, deviation, quartiles and eight directions of gradients. Works in place: arrays that stay in the cache
    are most of the speed, and what is sorted once need not be partitioned and searched."""
    turns = np.arctan2(down, across).ravel()
    turns.sort()
    turns = np.diff(np.searchsorted(turns, np.linspace(-np.pi, np.pi, 9)[1:-1]), prepend=0, append=len(turns))
    down *= down
    across *= across
    down += across
    edge = np.divide(down, 2, out=across)
    np.sqrt(edge, out=edge)
    edges = [edge.mean(), edge.std(), (edge > 0.1).sum()]
    size = np.sqrt(down, out=down)
    mean, spread, size = size.mean(), size.std(), size.ravel()
    size.sort()
    return edges, [mean, spread, _quantile(size, 0.25), _quantile(size, 0.75), *turns]


def features_of(x: np.ndarray) -> np.ndarray:
    """222 numbers of a picture at 128 x 128 gray pixels: 5 of its values, 3 of its edges, 10 counts of local patterns, mean, deviation and median of each block of
    16 x 16 pixels, line by line, and 12 of its gradients: mean, deviation, quartiles, and counts of eight directions."""
    g = pixels._lanczos(pixels._luma_of_rgb(x), SIDE).astype(np.float64) / 255
    lbp = np.bincount(_uniform_patterns(g).ravel(), minlength=10)
    edges, gradients = _gradients(*_edges(g))
    blocks = g.reshape(SIDE // BLOCK, BLOCK, SIDE // BLOCK, BLOCK).swapaxes(1, 2).reshape(-1, BLOCK * BLOCK)
    means, spreads, mean, spread = blocks.mean(1), blocks.std(1), g.mean(), g.std()
    blocks.sort(axis=1)
    ordered = g.ravel()
    ordered.sort()
    return np.concatenate([[mean, spread, _quantile(ordered, 0.5), ordered[0], ordered[-1]], edges, lbp, np.stack([means, spreads, _quantile(blocks, 0.5)], 1).ravel(), gradients])


def features(rows: DataFrame, content_col: str = "content") -> DataFrame:
    """The rows with (features array<double>, error string) in place of an encoded image."""
    import pyarrow as pa

    from siftmill.functions import images

    def one(content: bytes | None) -> tuple:
        x, _, error = images.pixels_of(content)
        return (None, error) if x is None else (features_of(x), None)

    return images._mapped(rows, content_col, [("features", "array<double>", pa.list_(pa.float64())), ("error", "string", pa.string())], one)


@dataclass
class Components:
    """What turns vectors into components: (v - mean) / scale times the directions, one a row, of falling variance."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    explained: np.ndarray


def fit(rows: DataFrame, k: int = 64, vector_col: str = "features", most: int = 4096, groups: int = 64) -> Components:
    """Principal components of standardised vectors: min(k, rows, dimensions) of them.

    Tasks sum vectors and their products, shifted by one of the vectors; the sums of tasks meet in `groups` sums, which is what reaches the
    driver: `groups` times the square of the dimensions, at most `most` of which are taken. Constant dimensions have scale 1; of each direction the entry
    of largest size is positive. Null vectors do not count; vectors of different lengths, and tables without any, raise.
    """
    v = rows.select(F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    first = v.first()
    if first is None:
        raise ValueError("no vectors")
    shift = np.array(first.v, float)
    p = len(shift)
    if p > most:
        raise ValueError(f"{p} dimensions are more than {most}")
    kind = "k int, n long, s binary, q binary"

    def total(parts: Iterator[tuple[int, bytes, bytes]], key: int) -> pd.DataFrame:
        n, s, q = 0, np.zeros(p), np.zeros((p, p))
        for m, a, b in parts:
            n, s, q = n + m, s + np.frombuffer(a), q + np.frombuffer(b).reshape(p, p)
        return pd.DataFrame({"k": [key], "n": [n], "s": [s.tobytes()], "q": [q.tobytes()]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, key = 0, np.zeros(p), np.zeros((p, p)), 0
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), float) - shift
                if x.shape != (len(pdf), p):
                    raise ValueError("vectors of different lengths")
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
                key = hash(x.tobytes()) % groups
        if n:
            yield pd.DataFrame({"k": [key], "n": [n], "s": [s.tobytes()], "q": [q.tobytes()]})

    sums = v.mapInPandas(partial, kind).groupBy("k").applyInPandas(lambda pdf: total(zip(pdf["n"], pdf["s"], pdf["q"], strict=True), int(pdf["k"].iloc[0])), kind)
    one = total(((r.n, bytes(r.s), bytes(r.q)) for r in sums.toLocalIterator()), 0).iloc[0]
    n, s, q = int(one["n"]), np.frombuffer(one["s"]), np.frombuffer(one["q"]).reshape(p, p)
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-12] = 1.0
    variance, directions = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-variance, kind="stable")[: min(k, n, p)]
    d = directions[:, order].T
    d = d * np.sign(d[np.arange(len(d)), np.abs(d).argmax(1)])[:, None]
    return Components(mean + shift, scale, d, np.maximum(variance[order], 0))


def transform(rows: DataFrame, model: Components, vector_col: str = "features", out_col: str = "hash_vector") -> DataFrame:
    """The rows with their vector's components as `out_col`; null vectors have none."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([None if v is None else (m.directions @ ((np.asarray(v, float) - m.mean) / m.scale)).tolist() for v in vectors], dtype=object)

    return rows.withColumn(out_col, project(F.col(vector_col).cast("array<double>")))


def changed(images: DataFrame, cache: DataFrame, id_col: str = "path", size_col: str = "size", time_col: str = "mtime", key_col: str = "key") -> DataFrame:
    """Images (path, size, mtime) that a cache (path, key) does not have as they are: their key, the first 16 hex digits of the MD5 of name_size_mtime, is added."""
    from siftmill.functions import hashing, uris

    x = images.withColumn(key_col, hashing.cache_key(uris.base_name(F.col(id_col)), F.col(size_col), F.col(time_col)))
    have = cache.select(F.col(id_col).alias("_p"), F.col(key_col).alias("_k"))
    return x.join(have, (F.col(id_col) == F.col("_p")) & (F.col(key_col) == F.col("_k")), "left_anti")
