"""Operators that SQL cannot express, and the pipeline, against plain Python that shares no code with them."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("siftmill.llm")
from siftmill.llm import byte_cnn, mixing, qda, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def discriminant(x, y, shrink=0.2, to_diagonal=0.1):
    """Class covariances from their definition; the log density by solving, not by cached factors."""
    centre, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))
    z = (x - centre) / scale
    own = {c: z[y == c] for c in (0, 1)}
    cov = {c: np.cov(v.T, ddof=0) for c, v in own.items()}
    pooled = sum(len(own[c]) * cov[c] for c in (0, 1)) / len(z)

    def score(q):
        logs = []
        for c in (0, 1):
            s = (1 - shrink) * cov[c] + shrink * pooled
            s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(pooled)) + 1e-2 * np.eye(len(s))
            d = (q - centre) / scale - own[c].mean(0)
            logs.append(math.log(len(own[c]) / len(z)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ni->n", d, np.linalg.solve(s, d.T).T))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    return score


@needs_tables
def test_discriminant_is_the_textbook_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = {r.doc_id: qda.statistics((r.text or "").encode()) for r in docs}
    train = [i for i in x if i in labels and not held_out(i)]
    score = discriminant(np.array([x[i] for i in train]), np.array([labels[i] for i in train]))
    want = dict(zip(x, score(np.array(list(x.values()))), strict=True))
    got = queries.op7_quality_qda(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == held_out(r.doc_id) and r.predicted == (r.score >= 0.5)
        assert abs(r.score - want[r.doc_id]) < 1e-6


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(3)
    x = rng.integers(97, 123, (5, 24)).astype(np.uint8)
    y = rng.integers(0, 3, 5)
    p = {"e": rng.normal(size=(256, 4)), "o": rng.normal(size=(6 * len(byte_cnn.WIDTHS), 3)), "ob": rng.normal(size=3)}
    for w in byte_cnn.WIDTHS:
        p[f"k{w}"], p[f"b{w}"] = rng.normal(size=(w, 4, 6)), rng.normal(size=6)
    _, grad = byte_cnn.loss_and_gradients(p, x, y)
    for k, v in p.items():
        flat = v.reshape(-1)
        spots = rng.choice(flat.size, min(25, flat.size), replace=False) if k != "e" else x[0, :8].astype(int) * 4 + 1
        for i in spots:
            keep, sides = flat[i], []
            for step in (1e-6, -1e-6):
                flat[i] = keep + step
                sides.append(byte_cnn.loss_and_gradients(p, x, y)[0])
            flat[i] = keep
            assert abs((sides[0] - sides[1]) / 2e-6 - grad[k].reshape(-1)[i]) < 1e-5, (k, i)


def test_language_of_whole_texts_is_the_weighted_mean_of_windows(spark):
    rng = np.random.default_rng(5)
    windows = rng.integers(97, 123, (30, byte_cnn.WINDOW)).astype(np.uint8)
    m = byte_cnn.train(windows, ["a", "b", "c"] * 10, epochs=1)
    texts = {1: "Äbc DEF. " * 90, 2: "x", 3: "".join(map(chr, rng.integers(97, 123, 3000))), 4: "12 34", 5: None, 6: "zé" * 700, 7: ""}

    def plain(text):
        data = text.encode().lower() if text else b""
        letters = [c for c in data if 97 <= c < 123 or c >= 128]
        if not letters:
            return "und", 0.0
        total, weight = np.zeros(3), 0
        for at in range(0, len(data), byte_cnn.WINDOW):
            x = data[at : at + byte_cnn.WINDOW].ljust(byte_cnn.WINDOW)
            top = []
            for w in byte_cnn.WIDTHS:
                span = [sum(m.embed[x[i + j]] @ m.filters[w][j] for j in range(w)) for i in range(len(x) - w + 1)]
                top.append(np.maximum(np.max(span, 0) + m.bias[w], 0))
            z = np.concatenate(top) @ m.out + m.out_bias
            n = sum(97 <= c < 123 or c >= 128 for c in x)
            total += n * (z - z.max() - math.log(np.exp(z - z.max()).sum()))
            weight += n
        p = np.exp(total / weight - (total / weight).max())
        return m.langs[int(p.argmax())], float(p.max() / p.sum())

    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in byte_cnn.predict(df, m).collect():
        want = plain(texts[r.doc_id])
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-4


def level_fill(total, children):
    """Shares by bisection of the level at which children (weight, capacity) fill up."""
    total = min(total, sum(c for _, c in children.values()))
    lo, hi = 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for w, c in children.values()) < total else (lo, mid)
    return {k: min(c, hi * w) for k, (w, c) in children.items()}


def plain_mix(rows, weights, max_epochs, total=None, seed=17):
    """(doc_id, leaf, epoch, tokens, start) of `rows` (doc_id, leaf of three names, tokens)."""
    have = Counter()
    for _, leaf, tok in rows:
        have[leaf] += tok
    amount = {(): sum(have.values()) if total is None else total}
    for depth in range(3):
        below = defaultdict(Counter)
        for leaf, n in have.items():
            below[leaf[:depth]][leaf[: depth + 1]] += n
        for node, kids in below.items():
            stated = {k: weights[k] for k in kids if k in weights}
            spare = max(1 - sum(stated.values()), 0) if stated else 1.0
            rest = sum(n for k, n in kids.items() if k not in stated) or 1
            amount |= level_fill(amount[node], {k: (stated.get(k, spare * n / rest), n * max_epochs) for k, n in kids.items()})
    out = []
    for leaf, n in have.items():
        budget, epoch, base = int(amount[leaf] + 1e-6), 0, 0
        own = [(i, t) for i, at, t in rows if at == leaf]
        while base < budget and n:
            start = 0
            order = sorted(own, key=lambda r: (hashlib.md5(f"{seed}/{epoch}/{r[0]}".encode()).hexdigest()[:15], r[0], r[1]))  # noqa: B023
            for i, t in order:
                if start < min(budget - base, n):
                    out.append((i, leaf, epoch, t, base + start))
                start += t
            base, epoch = base + n, epoch + 1
    return out


def plain_leaf(r):
    end = re.search(r"([0-9]+)$", r["source"] or "")
    return ("reference" if end and int(end[1]) % 2 == 0 else "web", r["lang"] or "", r["source"] or "")


@pytest.mark.parametrize("total", [None, 40_000, 3])
def test_mixture_is_recomputed(spark, total):
    import random

    rnd = random.Random(11)
    rows = [{"doc_id": i, "text": "t" * rnd.randrange(0, 900), "lang": rnd.choice(["en", "de", "fr"]), "source": rnd.choice(["a1", "b2", "c3", "c3", "c3", "d4"])} for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, total, queries.MIX_WEIGHTS, queries.domain(), max_epochs=3, rows_per_bucket=20).collect()
    want = plain_mix([(r["doc_id"], plain_leaf(r), -(-len(r["text"]) // 4)) for r in rows], queries.MIX_WEIGHTS, 3, total)
    assert sorted((r.doc_id, (r.domain, r.lang, r.source), r.epoch, r.tokens, r.start) for r in got) == sorted(want)


@needs_tables
def test_pipeline_is_recomputed(spark):
    """All five stages on the smallest tables, in plain Python."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    import regex  # noqa: F401
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    docs = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    # quality
    x = {i: qda.statistics((r["text"] or "").encode()) for i, r in docs.items()}
    train = [i for i in x if i in labels and not held_out(i)]
    score = discriminant(np.array([x[i] for i in train]), np.array([labels[i] for i in train]))
    docs = {i: r for i, r in docs.items() if score(np.array([x[i]]))[0] >= 0.5}
    # near copies
    sets = {}
    for i, r in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in docs}
    for _ in root:
        moved = False
        for a in docs:
            for b in docs:
                both = len(sets[a] & sets[b])
                if both and root[a] != root[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
                    moved = True
        if not moved:
            break
    docs = {i: r for i, r in docs.items() if root[i] == i}
    # repeats
    seen = Counter(t[j : j + 400] for r in docs.values() for t in [(r["text"] or "").encode()] for j in range(len(t) - 399))
    for r in docs.values():
        t = (r["text"] or "").encode()
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 399):
            if seen[t[j : j + 400]] > 1:
                gone[j : j + 400] = True
        r["text"] = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
    # mixture and tokens
    mix = plain_mix([(i, plain_leaf(r), -(-len(r["text"].encode()) // 4)) for i, r in docs.items()], queries.MIX_WEIGHTS, 3)
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((i, enc.encode_ordinary(docs[i]["text"])) for i, *_ in mix)
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want
