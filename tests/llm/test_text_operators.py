"""Row-wise text operators: against plain Python, and on odd input."""

import base64
import hashlib
import re
from collections import Counter

import pytest

from siftmill.llm import byte_bpe, byte_cnn, qda, quality_rules

P = pytest.importorskip("public_tokenizers")
ODD = [
    (1, None), (2, ""), (3, "x"), (3, "x"), (4, "a b c d e " * 3000), (5, "Ünïcödé — 日本語 🎉🎉\x00 \x85 z"), (6, "<|endoftext|> <|im_end|>"), (None, "no id"),
    (7, "same line\nsame line\n\nsame line"), (8, " \t\n\x0b\x0c\r "), (9, "#### $$$ | | <b>"), (10, "x" * 100_000), (11, "CAPS " * 60),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1.0, "z", b"q") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_words double, fail_bits string, f binary")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_ledger_measures(odd):
    got = quality_rules.ledger(odd).collect()
    assert len(got) == len(ODD)
    for (i, t), r in zip(ODD, got, strict=True):
        assert r.doc_id == i
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(t)
        assert bool(r.fail_bits & 1) == (r.n_words < 50)
        assert bool(r.fail_bits & 2) == (100 * r.n_repeat_words > 50 * r.n_words)


def test_policies_and_ablation(odd, empty):
    led = quality_rules.ledger(odd)
    for version, mask in quality_rules.POLICIES.items():
        bits = [r.fail_bits for r in led.collect()]
        assert [r.kept for r in quality_rules.apply_policy(led, version).collect()] == [b & mask == 0 for b in bits]
        for r in quality_rules.ablate(led, version).collect():
            bit = 1 << r.bit
            assert r.n_failed == sum(1 for b in bits if b & bit)
            assert r.n_failed_alone == sum(1 for b in bits if b & bit and not b & mask & ~bit)
            assert r.n_kept_without == sum(1 for b in bits if not b & mask & ~bit)
    assert quality_rules.ledger(empty).count() == 0
    assert all(r.n_failed == 0 for r in quality_rules.ablate(quality_rules.ledger(empty), 2).collect())


@pytest.fixture(scope="module")
def tik():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(odd, tik, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    got = byte_bpe.round_trip(odd, path, P.PATTERN).collect()
    for (i, t), r in zip(ODD, got, strict=True):
        ids = tik.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip(empty, path, P.PATTERN).count() == 0


def test_bpe_offsets_and_cut_characters(odd, tik):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encode(odd, path, P.PATTERN)
    for (_, t), r in zip(ODD, enc.collect(), strict=True):
        assert list(r.ids) == tik.encode_ordinary(t or "")
        data = (t or "").encode()
        c = byte_bpe.codec(path, P.PATTERN)
        assert all(data[s:e] == c.bytes_of[i] for i, s, e in zip(r.ids, r.starts, r.ends, strict=True))
        assert (list(r.ends) or [0])[-1] == len(data)
    back = byte_bpe.decode(enc, path, P.PATTERN).collect()
    assert [bytes(r.text_bytes) for r in back] == [(t or "").encode() for _, t in ODD]
    c = byte_bpe.codec(path, P.PATTERN)
    ids = c.encode("🎉")
    assert len(ids) > 1 and c.decode_text(ids[:1]).endswith("�") and c.decode(ids) == "🎉".encode()


def test_bpe_cache_may_be_emptied(monkeypatch):
    c = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = " ".join(f"w{i}" for i in range(300))
    want = c.encode(text)
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 10)
    assert [c.encode(text) for _ in range(3)] == [want] * 3
    assert [ids for ids, _ in c.encode_all([text, "w1 " + "y" * 500, ""])][0] == want
    assert not any(len(p) > byte_bpe.CACHE_PIECE_CHARS for p in c.ids_of)


def samples(spark, n=300):
    good = [(i, "the quick brown fox jumps over the lazy dog and runs away, then sleeps. " * (1 + i % 7), 1) for i in range(n)]
    bad = [(n + i, "BUY$$$ *** NOW!!! ### | | %%% " * (1 + i % 7), 0) for i in range(n)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    return df


def test_qda(spark, odd, empty):
    df = samples(spark)
    feats = qda.featurise(df)
    held = df.where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1")
    train = feats.join(held, "doc_id", "left_anti")
    model = qda.fit(train, df)
    got = {r.doc_id: r.predicted for r in qda.score(feats.join(held, "doc_id", "left_semi"), model).collect()}
    want = {r.doc_id: r.quality for r in held.collect()}
    assert sum(got[k] == v for k, v in want.items()) >= 0.95 * len(want)
    s = qda.score(qda.featurise(odd), model).collect()
    assert len(s) == len(ODD) and all(0 <= r.score <= 1 for r in s)
    assert {r.doc_id for r in qda.keep_good(df, model).collect()} == {r.doc_id for r in qda.score(feats, model).collect() if r.predicted == 1}
    none = qda.fit(qda.featurise(empty), spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.score == 0.5 for r in qda.score(qda.featurise(odd), none).collect())
    assert qda.score(qda.featurise(empty), model).count() == 0


def test_qda_matches_direct_formula(spark):
    import numpy as np

    df = samples(spark, 60)
    model = qda.fit(qda.featurise(df), df)
    x = np.array([qda.statistics(r.text.encode()) for r in df.collect()])
    z = (x - model.centre) / model.scale
    logs = []
    for c in (0, 1):
        mean, white, const = model.classes[c]
        cov = np.linalg.inv(white) @ np.linalg.inv(white).T
        d = z - mean
        logs.append(const - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500))), atol=1e-6)


def test_language(spark, odd, empty):
    words = {"en": "the and of to in is that with for".split(), "de": "der und die das nicht mit für sich".split(), "fr": "le la les est dans pour que avec".split()}
    import random

    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(words[lang], k=40)), lang) for i, lang in enumerate(sorted(words) * 120)]
    df = spark.createDataFrame(rows + [(9999, None, "en"), (10000, "the and", None)], "doc_id long, text string, lang string")
    model = byte_cnn.fit(df.where("doc_id % 4 <> 1"))
    got = {r.doc_id: r.lang_pred for r in byte_cnn.predict(df, model).collect()}
    held = [r for r in rows if r[0] % 4 == 1]
    assert sum(got[i] == lang for i, _, lang in held) >= 0.95 * len(held)
    assert got[9999] == "und"
    res = byte_cnn.predict(odd, model).collect()
    assert len(res) == len(ODD) and all(0 <= r.score <= 1 for r in res)
    assert [r.lang_pred for (_, t), r in zip(ODD, res, strict=True) if not t or not any(c.isalpha() for c in t)] == ["und"] * sum(1 for _, t in ODD if not t or not any(c.isalpha() for c in t))
    assert byte_cnn.predict(empty, model).count() == 0
    nothing = byte_cnn.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in byte_cnn.predict(odd, nothing).collect()} == {"und"}


def test_convolution_by_tables_is_convolution():
    import numpy as np

    x = np.random.default_rng(1).integers(97, 123, (6, byte_cnn.WINDOW)).astype(np.uint8)
    m = byte_cnn.train(x, ["a", "b", "c"] * 2, epochs=1)
    m.tables()
    got = m.pooled(x)
    parts = []
    for w in byte_cnn.WIDTHS:
        e = m.embed[x]
        n = x.shape[1] - w + 1
        z = sum(e[:, j : j + n] @ m.filters[w][j] for j in range(w))
        parts.append(np.maximum(z.max(1) + m.bias[w], 0))
    assert np.allclose(got, np.concatenate(parts, 1), atol=1e-4)
