"""The fine metric scores whole only what a third of its windows leaves possible."""

import numpy as np

from siftmill.operators import fine


def test_pairs_ruled_out_early_are_not_scored_whole(monkeypatch):
    rng = np.random.default_rng(0)
    a = rng.random((12, 64, 64))
    a[0], a[1] = 0.5, 0.0
    b = np.clip(np.concatenate((a + rng.normal(0, 1, a.shape) * np.linspace(0, 0.4, 12)[:, None, None], 1 - a)), 0, 1)
    want, whole = fine.similarities(a, b), []
    plain = fine.similarities

    def counted(x, y, lines=1):
        if lines == 1:
            whole.append(len(x) * len(y))
        return plain(x, y, lines)

    monkeypatch.setattr(fine, "similarities", counted)
    for least in (0.2, 0.5, 0.8, 0.99):
        i, j, s = fine.alike(a, b, least, np.ones(want.shape, bool))
        p, q = np.nonzero(want >= least)
        assert list(zip(i, j, s, strict=True)) == list(zip(p, q, want[p, q], strict=True))
    whole.clear()
    fine.alike(a, b, 0.8, np.ones(want.shape, bool))
    assert sum(whole) < want.size / 4
    among = np.zeros(want.shape, bool)
    assert [len(x) for x in fine.alike(a, b, 0.0, among)] == [0, 0, 0]
