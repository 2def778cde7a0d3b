"""Steps of the pixel measures against their plain definitions; an image's colours are measured once."""

import numpy as np
import pytest

from siftmill.functions import pixels


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (3, 2), (40, 16), (7, 48), (161, 33)])
def test_steps_equal_plain_definitions(shape):
    rng = np.random.default_rng(shape[0])
    m = rng.random(shape) < 0.05
    for rows, cols in ((3, 15), (3, 1), (1, 3)):
        want = np.zeros(shape, bool)
        for y, x in zip(*np.nonzero(m), strict=True):
            want[max(0, y - rows // 2) : y + rows // 2 + 1, max(0, x - cols // 2) : x + cols // 2 + 1] = True
        assert (pixels._dilate(m, rows, cols) == want).all()
    g = rng.integers(0, 256, shape).astype(np.float64)
    p = np.pad(g, 1, mode="reflect")
    gx, gy = pixels._sobel(g)
    assert (gx == (p[:-2] + 2 * p[1:-1] + p[2:])[:, 2:] - (p[:-2] + 2 * p[1:-1] + p[2:])[:, :-2]).all() and gy.shape == shape
    whole, half = rng.integers(0, 256, shape, dtype=np.uint8), 1 << 21
    w, v = (pixels._lanczos_weights(k, 40).astype(np.int64) for k in shape[::-1])
    want = whole.astype(np.int64) if shape[1] == 40 else np.clip((whole.astype(np.int64) @ w.T + half) >> 22, 0, 255)
    want = want if shape[0] == 40 else np.clip((v @ want + half) >> 22, 0, 255)
    assert (pixels._lanczos(whole, 40) == want).all()


def test_colours_are_not_measured_again(monkeypatch):
    x = np.full((60, 48, 1), 255, np.uint8)
    for y in range(4, 56, 6):
        x[y : y + 2, 4:40] = 0
    kind, want = pixels.colour_stats_of(x), pixels.text_scores_of(x)
    assert want["total"] > 0
    monkeypatch.setattr(pixels, "colour_stats_of", None)
    assert pixels.text_scores_of(x, kind) == want
