"""Maximal repeats against brute force."""

import random

import numpy as np
import pytest

from siftmill.llm import repeat_groups, suffix_dedup

SCHEMA = "doc_id long, text string, id string, core long, repeat string, g binary"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", b"z") for i, t in rows], SCHEMA)


def brute(rows, n):
    """All maximal repeats: (bytes, sorted places)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    out, length = [], n
    spots = [(k, s) for k, (_, t) in enumerate(texts) for s in range(len(t))]
    while spots:
        places = {}
        for k, s in spots:
            if s + length <= len(texts[k][1]):
                places.setdefault(texts[k][1][s : s + length], []).append((k, s))
        spots = []
        for x, at in places.items():
            if len(at) < 2:
                continue
            spots += at
            before = {texts[k][1][s - 1] if s else -1 for k, s in at}
            after = {texts[k][1][s + length] if s + length < len(texts[k][1]) else -1 for k, s in at}
            if (len(before) > 1 or -1 in before) and (len(after) > 1 or -1 in after):
                out.append((x, sorted((texts[k][0] is None, texts[k][0] or 0, s) for k, s in at)))
        length += 1
    return sorted(out)


def found(spark, rows, n):
    texts, groups = {}, {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode())
    for r in repeat_groups.MaximalRepeats(frame(spark, rows), min_len=n).groups().collect():
        groups.setdefault((r.repeat, r.length), []).append((r.doc_id is None, r.doc_id or 0, r.start, r.doc_id))
    out = []
    for (digest, length), places in groups.items():
        (x,) = {t[s : s + length] for _, _, s, i in places for t in texts[i] if repeat_groups._digest(t[s : s + length]) == digest}
        out.append((x, sorted(p[:3] for p in places)))
    return sorted(out)


def nested_rows(seed):
    """Passages within passages, parts that recur alone, copies, short periods."""
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choices("ab" if seed % 2 else "abcdefgh é", k=k))
    x, y, z = text(35), text(90), text(200)
    rows = [(1, x + y + z), (2, text(20) + x + y + z), (3, text(9) + y), (4, y + z[:60]), (5, z[100:] + text(5)), (6, text(30) + z[20:120] + x + y[:50])]
    rows += [(i, text(rnd.randrange(20)) + rnd.choice((x, y, z))[rnd.randrange(20) :] + text(rnd.randrange(30))) for i in range(7, 14)]
    return rows + [(20, "abc" * 40), (21, "q" * 90), (22, rows[2][1]), (22, rows[2][1]), (None, y + "!"), (23, None), (24, ""), (25, "x" * 39)]


@pytest.mark.parametrize("seed", range(2))
def test_all_maximal_repeats(spark, seed):
    rows = nested_rows(seed)
    assert found(spark, rows, 40) == brute(rows, 40)


def test_divided_groups_give_the_same(spark, monkeypatch):
    """Groups of more than 3 contexts are divided down to single strings."""
    monkeypatch.setattr(suffix_dedup, "GROUP_MAX", 3)
    rows = [r for r in nested_rows(4) if r[0] not in (20, 21)]
    assert found(spark, rows, 40) == brute(rows, 40)


def test_whole_passages_around_a_part_that_recurs_alone(spark):
    rnd = random.Random(5)
    x, y, z, other = ("".join(rnd.choices("abcdefgh ", k=k)) for k in (1500, 3000, 1500, 700))
    rows = [(1, x + y + z), (2, x + y + z), (3, other + y)]
    got = found(spark, rows, 400)
    assert [(len(s), places) for s, places in got] == sorted([(6000, [(False, 1, 0), (False, 2, 0)]), (3000, [(False, 1, 1500), (False, 2, 1500), (False, 3, 700)])], key=lambda g: (x + y + z if g[0] == 6000 else y).encode())


def test_odd_tables(spark):
    assert repeat_groups.MaximalRepeats(frame(spark, []), min_len=40).groups().count() == 0
    assert found(spark, [(1, None), (1, ""), (None, "short"), (2, "x" * 40)], 40) == []
    t = "0123456789" * 4 + "é"
    assert found(spark, [(1, t), (1, t), (None, t)], 40) == brute([(1, t), (1, t), (None, t)], 40)


def test_anchors_of_long_windows():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 2_600_000, dtype=np.uint8)
    pos, _ = suffix_dedup.anchors(buf, 800_000)
    assert len(pos) and (np.diff(pos) <= 600_001).all()
