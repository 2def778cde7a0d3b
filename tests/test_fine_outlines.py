"""The bound of the fine metric's outlines holds for all kinds of pictures, and leaves of unlike ones nothing to score."""

import numpy as np

from siftmill.functions import pixels
from siftmill.operators import fine


def test_outlines_bound_similarities():
    rng = np.random.default_rng(3)
    for side in (11, 24, 64):
        flat = np.stack([np.full((side, side), v) for v in (0.0, 0.5, 1.0)])
        noise = rng.random((6, side, side))
        steps = np.stack([np.kron(rng.random((-(-side // n),) * 2), np.ones((n, n)))[:side, :side] for n in (2, 5, 12)])
        x = np.concatenate((flat, noise, steps, 1 - noise[:2], noise[:2] * 0.3, steps * 0.5 + 0.2, np.where(np.arange(side) < side // 2, 1.0, noise[:2])))
        most, want = fine.at_most(fine.outlines(x), fine.outlines(x)), fine.similarities(x, x)
        assert (most >= want - fine.SLACK).all() and most.max() < 1 + fine.SLACK


def test_unlike_pictures_are_not_scored(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 64))
    v[290:] = v[:10] + rng.normal(0, 0.01, (10, 64))
    v /= np.abs(v).max(1, keepdims=True)
    x = np.rint((0.5 + 0.5 * v[:, :, None] * v[:, None, :]) * 65535).astype(np.uint16)
    scored, plain = [], fine._scored

    def counted(*args):
        scored.append(len(args[3]))
        return plain(*args)

    among = np.triu(np.ones((300, 300), bool), 1)
    want = fine.similarities(x / 65535, x / 65535)
    monkeypatch.setattr(fine, "_scored", counted)
    i, j, s = fine.alike(x, x, 0.8, among)
    p, q = np.nonzero(among & (want >= 0.8))
    assert list(zip(i, j, s, strict=True)) == list(zip(p, q, want[p, q], strict=True)) and set(zip(range(10), range(290, 300), strict=True)) <= set(zip(i, j, strict=True))
    assert sum(scored) <= len(i) + 20
    assert len(fine.alike(x[:0], x, 0.8, among[:0])[0]) == 0


def test_weights_of_pictures_of_one_size_are_made_once():
    x = np.random.default_rng(7).integers(0, 256, (40, 60)).astype(float)
    want = np.array([[x[i * 5 : i * 5 + 5, j * 5 : j * 5 + 5].mean() for j in range(12)] for i in range(8)])
    assert np.allclose(pixels._resize(x, 8, 12), want) and np.allclose(pixels._resize(x, 40, 60), x)
    assert pixels._area_weights(40, 8) is pixels._area_weights(40, 8) and pixels._dct(32) is pixels._dct(32)
