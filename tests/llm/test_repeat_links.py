"""Links of repeated windows against brute force."""

import random

import pytest
from test_repeat_groups import frame, nested_rows

from siftmill.llm import repeat_links, suffix_dedup


def brute(rows, n):
    """Runs of windows of n bytes that occur again, with their first occurrences."""
    texts = [((i is not None, i or 0, suffix_dedup._text_hash((t or "").encode())), (t or "").encode()) for i, t in rows]
    places = {}
    for key, t in texts:
        for s in range(len(t) - n + 1):
            places.setdefault(t[s : s + n], []).append((key, s))
    out = []
    for key, t in texts:
        run = None
        for s in range(len(t) - n + 1):
            at = places[t[s : s + n]]
            (first, f) = min(at)
            if len(at) > 1 and run and run[0] + run[1] - n + 1 == s and run[2] == first and run[3] + s - run[0] == f:
                run[1] += 1
                continue
            if run:
                out.append((key, *run))
            run = [s, n, first, f] if len(at) > 1 else None
        if run:
            out.append((key, *run))
    return sorted((key[:2], s, length, first[:2], f) for key, s, length, first, f in out)


def found(spark, rows, n):
    got = repeat_links.RepeatLinks(frame(spark, rows), min_len=n).links().collect()
    key = lambda i: (i is not None, i or 0)
    return sorted((key(r.doc_id), r.start, r.length, key(r.first_doc_id), r.first_start) for r in got)


@pytest.mark.parametrize("seed", range(2))
def test_links_of_nested_passages_copies_and_periods(spark, seed):
    rows = nested_rows(seed)
    assert found(spark, rows, 40) == brute(rows, 40)


@pytest.mark.parametrize("limit", (1, 3))
def test_divided_groups_give_the_same_links(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "GROUP_MAX", limit)
    rows = nested_rows(4)
    assert found(spark, rows, 40) == brute(rows, 40)


def test_links_grow_with_the_texts(spark):
    """Passages nested in each other and many copies of all: as lists of occurrences, each passage has those of all that hold it."""
    rnd = random.Random(1)
    x = "".join(rnd.choices("abcdefgh ", k=2400))
    parts = [(i, x[: 2400 - 40 * (i % 40)]) for i in range(160)]
    got = found(spark, parts, 400)
    assert got == [((True, i), 0, len(t), (True, 0), 0) for i, t in parts]


def test_odd_tables(spark):
    assert found(spark, [], 40) == []
    assert found(spark, [(1, None), (1, ""), (None, "short"), (2, "x" * 40)], 40) == []
    t = "0123456789" * 4 + "é"
    rows = [(1, t), (1, t), (None, t), (2, "z" * 41)]
    assert found(spark, rows, 40) == brute(rows, 40)
