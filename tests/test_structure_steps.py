"""Structure features from values sorted once and patterns looked up, against their plain definitions, bit by bit; small products stay in one thread."""

import numpy as np
import pytest

from siftmill.functions import pixels
from siftmill.operators import structure


def plain_patterns(g):
    h, w = g.shape
    p, bits = np.pad(g, 2), []
    for k in range(8):
        y, x = (round(float(v), 5) for v in (-np.sin(2 * np.pi * k / 8), np.cos(2 * np.pi * k / 8)))
        y0, x0 = int(np.floor(y)), int(np.floor(x))
        fy, fx = y - y0, x - x0
        at = lambda dy, dx: p[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]
        top, low = ((1 - fx) * at(v, x0) + fx * at(v, x0 + 1) for v in (y0, y0 + 1))
        bits.append(((1 - fy) * top + fy * low >= g).astype(int))
    b = np.stack(bits)
    return np.where(np.abs(b - np.roll(b, -1, axis=0)).sum(0) <= 2, b.sum(0), 9)


def plain_features(g):
    p = np.pad(g, 1, mode="symmetric")
    down, across = p[2:] - p[:-2], p[:, 2:] - p[:, :-2]
    down, across = (down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]) / 4, (across[:-2] + 2 * across[1:-1] + across[2:]) / 4
    edge, size = np.sqrt((down**2 + across**2) / 2), np.sqrt(down**2 + across**2)
    blocks = g.reshape(8, 16, 8, 16).swapaxes(1, 2).reshape(64, 256)
    counts = np.histogram(plain_patterns(g), bins=10, range=(0, 10))[0]
    turns = np.histogram(np.arctan2(down, across), bins=8, range=(-np.pi, np.pi))[0]
    parts = np.stack([blocks.mean(1), blocks.std(1), np.median(blocks, axis=1)], 1).ravel()
    return np.concatenate([[g.mean(), g.std(), np.median(g), g.min(), g.max()], [edge.mean(), edge.std(), (edge > 0.1).sum()], counts, parts, [size.mean(), size.std(), np.percentile(size, 25), np.percentile(size, 75)], turns])


@pytest.mark.parametrize("kind", ["noise", "few", "flat", "lines", "corner"])
def test_features_equal_plain_ones(kind, monkeypatch):
    rng = np.random.default_rng(5)
    x = {
        "noise": rng.integers(0, 256, (90, 48, 3)), "few": rng.integers(100, 103, (128, 128, 1)), "flat": np.full((5, 9, 1), 77), "lines": np.indices((128, 128)).sum(0)[:, :, None] % 7 * 30,
        "corner": (np.indices((128, 128)).min(0) > 60)[:, :, None] * 255,
    }[kind].astype(np.uint8)
    g = pixels._lanczos(pixels._luma_of_rgb(x), 128).astype(np.float64) / 255
    want = plain_features(g)

    def refuse(*args, **kwargs):
        raise AssertionError("not for every picture")

    for name in ("histogram", "median", "percentile"):  # half of the time of a picture was theirs
        monkeypatch.setattr(structure.np, name, refuse)
    assert np.array_equal(structure.features_of(x), want)


def test_products_by_strips():
    rng = np.random.default_rng(6)
    for m, k, n in ((1, 1, 1), (128, 70, 128), (128, 1400, 128), (3, 5000, 128)):
        a, b = rng.integers(-9, 9, (m, k)).astype(float), rng.integers(-9, 9, (k, n)).astype(float)
        assert np.array_equal(pixels._product(a, b), a @ b)
