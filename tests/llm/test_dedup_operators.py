"""Deduplication operators against brute force, and on odd input."""

import hashlib
import random
import re

import numpy as np
import pytest

from siftmill.llm import jaccard, near_embed, suffix_dedup

SCHEMA = "doc_id long, text string, id string, core long, k string, bits binary"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", b"z") for i, t in rows], SCHEMA)


def union(links, nodes):
    root = {n: n for n in nodes}

    def f(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((f(a), f(b)))
        root[b] = a
    return {n: f(n) for n in nodes}


def word_sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
    return out


def near_rows(seed, n=60, groups=8):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    hot = rnd.choices(vocab, k=60)
    rows = []
    bases = [rnd.choices(vocab, k=rnd.choice([6, 12, 40, 120, 300])) for _ in range(groups)]
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randrange(0, max(2, len(w) // 40 + 1))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if rnd.random() < 0.3:
            w = w + hot
        rows.append((i, " ".join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One  two"), (n + 4, " \n "), (n + 5, "z " * 40_000)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("lists", ["default", "long"])
def test_jaccard(spark, seed, lists, monkeypatch):
    if lists == "long":  # every list takes the block scan, in blocks of a few members, and every key that a chunk has twice is hot
        monkeypatch.setattr(jaccard, "HOT", 2)
        monkeypatch.setattr(jaccard, "CHUNK_POSTINGS", 200)
        monkeypatch.setattr(jaccard, "SHORT_LIST", 1)
        monkeypatch.setattr(jaccard, "BLOCK", 5)
    rows = near_rows(seed)
    sets = word_sets(rows)
    links = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[x + 1 :] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    want = union(links, [i for i, _ in rows])
    got = jaccard.join(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets}


def test_jaccard_odd(spark):
    assert jaccard.join(frame(spark, [])).count() == 0
    t = "a b c d e f g h"
    got = jaccard.join(frame(spark, [(5, t), (5, t), (None, t), (7, t), (8, None), (5, "x y z x y z")])).collect()
    assert len(got) == 6 and {r.component_id for r in got if r.doc_id in (5, 7)} == {5}
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_boundary_follows_cost():
    assert jaccard.choose_boundary({}, 1.0) == 0
    assert jaccard.choose_boundary({10: 100, 1000: 5}, 0.0) <= jaccard.choose_boundary({10: 100, 1000: 5}, 50.0)


@pytest.mark.parametrize("boundary", [0, 8, 30, 10**9])
def test_keys_meet(boundary):
    rng = np.random.default_rng(boundary)
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    for n in (4, 5, 9, 10, 11, 25, 40):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            b = a.copy()
            for _ in range(int(rng.integers(0, n // 4 + 1))):
                b = np.delete(b, rng.integers(0, len(b))) if rng.random() < 0.5 else np.unique(np.append(b, rng.integers(0, 1 << 62, dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * len(np.union1d(a, b)) and len(a) > 1 and len(b) > 1:
                assert set(jaccard.keys_of(a, boundary, *none)) & set(jaccard.keys_of(b, boundary, *none))
                assert jaccard.differ_at_least(jaccard.bitmap(a), jaccard.bitmap(b)) <= len(a) + len(b) - 2 * both <= jaccard.may_link(len(a), len(b))


def brute_cut(texts, n):
    count = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            count[t[i : i + n]] = count.get(t[i : i + n], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows(seed):
    rnd = random.Random(seed)
    alpha = "ab" if seed % 2 else "abcdefghij é"
    text = lambda k: "".join(rnd.choices(alpha, k=k))
    shared = [text(rnd.choice([30, 45, 70, 150])) for _ in range(5)]
    rows = [(i, "".join(rnd.choice([text(rnd.randrange(40)), rnd.choice(shared), rnd.choice(shared)[7:50]]) for _ in range(rnd.randrange(1, 9)))) for i in range(30)]
    return rows + [(30, None), (31, ""), (32, "a" * 300), (33, rows[0][1]), (34, "x" * 39), (35, "abc" * 50)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("group_max", [3000, 3])
def test_suffix_cut(spark, seed, group_max, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_MAX", group_max)  # 3: nearly all groups are divided by halving
    rows = repeat_rows(seed)
    got = suffix_dedup.Repeats(frame(spark, rows), min_len=40).cut().collect()
    want = brute_cut([(t or "").encode() for _, t in rows], 40)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {i: w for (i, _), w in zip(rows, want, strict=True)}


@pytest.mark.parametrize("group_max", [3000, 3])
def test_suffix_groups(spark, group_max, monkeypatch):
    """Groups are repeats, have all occurrences of their bytes, and together cover what repeats."""
    monkeypatch.setattr(suffix_dedup, "GROUP_MAX", group_max)
    rows = repeat_rows(2)
    texts = {i: (t or "").encode() for i, t in rows}
    groups = {}
    for r in suffix_dedup.Repeats(frame(spark, rows), min_len=40).groups().collect():
        groups.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    covered = {i: np.zeros(len(t), bool) for i, t in texts.items()}
    for (_, n), places in groups.items():
        assert n >= 40 and len(places) > 1
        content = {texts[i][s : s + n] for i, s in places}
        assert len(content) == 1
        x = content.pop()
        assert places == {(i, s) for i, t in texts.items() for s in range(len(t) - n + 1) if t[s : s + n] == x}
        for i, s in places:
            covered[i][s : s + n] = True
    want = brute_cut(list(texts.values()), 40)
    assert [int(c.sum()) for c in covered.values()] == [w[1] for w in want]


@pytest.mark.parametrize("group_max", [3000, 3])
def test_long_repeats_are_whole(spark, group_max, monkeypatch):
    """Repeats many times longer than a context, alone in their places, come as one group of that length."""
    monkeypatch.setattr(suffix_dedup, "GROUP_MAX", group_max)
    rnd = random.Random(8)
    text = lambda k: "".join(rnd.choices("abcdefgh ", k=k))
    copied, passage = text(700), text(333)
    rows = [(1, copied), (2, copied), (3, text(90) + "<" + passage + ">" + text(50)), (4, "[" + passage + "]"), (5, text(200) + "(" + passage + ")"), (6, text(400))]
    groups = {}
    for r in suffix_dedup.Repeats(frame(spark, rows), min_len=40).groups().collect():
        groups.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    assert sorted((n, tuple(sorted(p))) for (_, n), p in groups.items()) == [(333, ((3, 91), (4, 1), (5, 201))), (700, ((1, 0), (2, 0)))]


def test_suffix_odd(spark):
    assert suffix_dedup.Repeats(frame(spark, []), min_len=40).cut().count() == 0
    t = "0123456789" * 5 + "abc"
    got = suffix_dedup.Repeats(frame(spark, [(1, t), (1, t), (1, "short"), (None, t), (2, "xé" * 100)]), min_len=40).cut(with_text=True, carry=("id",)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(5, 0), (53, 53), (53, 53), (53, 53), (300, 300)]
    assert all(r.c.id == "x" for r in got)


def test_maximal_repeats_directly():
    lefts, rights = [b"ba", b"ba", b"bc"], [b"xyz1", b"xyz2", b"xyz2"]
    found = {(left, length, tuple(sorted(m))) for left, length, m, _ in suffix_dedup.maximal_repeats(lefts, rights, 4)}
    assert found == {(1, 3, (0, 1, 2)), (1, 4, (1, 2))} or (1, 3, (0, 1, 2)) in found and (1, 4, (1, 2)) in found
    assert list(suffix_dedup.intervals(np.array([0, 3, 3, 1]))) == [(3, 0, 2), (1, 0, 3), (0, 0, 3)]


def test_near_embeddings(spark, monkeypatch):
    monkeypatch.setattr(near_embed, "BLOCK", 7)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    vecs = [(int(i), (base[i % 12] + rng.normal(size=16) * rng.choice([0, 0.03, 0.12, 0.3])).astype(np.float32).tolist(), int(i % 12 // 6)) for i in range(160)]
    vecs += [(200, vecs[0][1], 0), (201, vecs[0][1], 0), (202, vecs[0][1], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] * 16, 0), (206, [None] + [1.0] * 15, 0), (207, [1.0] * 3, 0), (208, [], 0), (209, [float("inf")] * 16, 0), (210, [1e30] * 16, 0), (211, [1e-30] * 16, 0)]
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in vecs], "vec_id long, embedding array<float>, label int, id string, n int")
    ok = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in vecs if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(i, j) for x, (i, a, p) in enumerate(ok) for j, b, q in ok[x + 1 :] if p == q and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98]
    want = union(links, [i for i, _, _ in vecs])
    n = {i: sum(i in e for e in links) for i, _, _ in vecs}
    got = near_embed.near_duplicates(df, miss=1e-9).collect()
    assert len(got) == len(vecs)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], want[i], want[i] == i) for i, _, _ in vecs}
    assert near_embed.near_duplicates(df.limit(0)).count() == 0


def test_table_plan():
    bits, tables = near_embed.table_plan(10**9, 0.98)
    assert 4 <= bits <= 24 and (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 1e-4
