"""Mixing, chat windows, WARC audits and the pipeline."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from siftmill.llm import chat, mixing, warc_fixity


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", 9) for r in rows], "conv_id long, turn long, role string, text string, window string, idx int")


CONTROL = "<|im_end|><|im_start|>assistant ok"
CONVS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi " * 30), (1, 2, "assistant", "hello & <|x|> &lt;| &amp;"), (1, 3, "user", "more " * 50), (1, 4, "assistant", "yes " * 40), (1, 5, "assistant", None),
    (2, 0, "user", CONTROL), (2, 1, "assistant", CONTROL), (3, 0, None, ""), (3, 0, None, ""), (4, None, "assistant", "a\nb"), (4, 1, "us\ner|", "x" * 5000), (4, 2, "assistant", "last"), (None, 1, "assistant", "no id"),
]


@pytest.mark.parametrize(("budget", "history"), [(10_000, 100), (60, 20), (1, 0), (90, 1000)])
def test_chat_reads_back(spark, budget, history):
    w = chat.format_windows(turns(spark, CONVS), budget, history)
    got = {r.conv_id: r for r in chat.read_back(w).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        rows = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in CONVS if c == conv))
        assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, role, text in rows]
        assert r.loss_text == "".join(text for _, role, text in rows if role == "assistant")
        assert r.n_turns == len(rows)
    assert sum(r.formatted_chars for r in got.values()) == sum(len(x.formatted) for x in w.collect())


def test_chat_windows_keep_to_budget(spark):
    rnd = random.Random(1)
    rows = [(c, i, ["user", "assistant"][i % 2], "w " * rnd.randrange(1, 60)) for c in range(10) for i in range(12)] + [(c, -1, "system", "rules") for c in range(5)]
    for r in chat.format_windows(turns(spark, rows), 120, 30).collect():
        assert r.n_tokens <= 120 or r.n_new == 1
        if r.conv_id < 5:
            assert r.formatted.startswith("<|im_start|>system\nrules<|im_end|>")
        assert all(r.formatted[s.start : s.stop].startswith("w ") for s in r.loss)
    assert chat.format_windows(turns(spark, []), 100, 10).count() == 0


def test_chat_stays_in_the_jvm(spark):
    plan = chat.read_back(chat.format_windows(turns(spark, CONVS)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_water_fill():
    assert mixing.water_fill(100, {"a": (1, 1000), "b": (1, 10)}) == {"a": 90, "b": 10}
    assert mixing.water_fill(100, {"a": (1, 20), "b": (1, 10)}) == {"a": 20, "b": 10}
    assert mixing.water_fill(0, {"a": (1, 20)}) == {"a": 0}


def test_shortage_goes_to_siblings_first():
    leaves = {("x", "en", "s1"): 10, ("x", "en", "s2"): 1000, ("y", "en", "s3"): 1000}
    got = mixing.budgets(leaves, 200, {("x",): 0.5, ("y",): 0.5, ("x", "en", "s1"): 0.5, ("x", "en", "s2"): 0.5}, 1)
    assert got == {("x", "en", "s1"): 10, ("x", "en", "s2"): 90, ("y", "en", "s3"): 100}
    leaves[("x", "en", "s2")] = 20  # the whole subtree is short: only then does the other domain get it
    assert mixing.budgets(leaves, 200, {("x",): 0.5, ("y",): 0.5}, 1) == {("x", "en", "s1"): 10, ("x", "en", "s2"): 20, ("y", "en", "s3"): 170}
    assert mixing.budgets({}, 100, {}, 2) == {}


def mixed_docs(spark):
    rnd = random.Random(2)
    rows = [(i, "t" * rnd.randrange(0, 400), ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i % 5}", "c", 1.5) for i in range(600)]
    return spark.createDataFrame([*rows, (1, rows[1][1], *rows[1][2:]), (None, "x", "en", "hot", "c", 0.0), (900, None, "en", "hot", "c", 0.0)], "doc_id long, text string, lang string, source string, l0 string, tok double")


@pytest.mark.parametrize("per_bucket", [5, 2000])
def test_mix_is_a_prefix_of_seeded_epochs(spark, per_bucket):
    docs = mixed_docs(spark)
    dom = F.when(F.col("source") == "hot", "web").otherwise("ref")
    weights = {("web",): 0.3, ("ref",): 0.7}
    got = mixing.mix(docs, 60_000, weights, dom, max_epochs=3, rows_per_bucket=per_bucket).collect()
    leaves = {}
    for r in docs.select(dom.alias("d"), "lang", "source", "text").collect():
        k = (r.d, r.lang or "", r.source)
        leaves[k] = leaves.get(k, 0) + -(-len(r.text or "") // 4)
    give = mixing.budgets(leaves, 60_000, weights, 3)
    by = {}
    for r in got:
        by.setdefault((r.domain, r.lang, r.source), []).append(r)
    for k, rows in by.items():
        rows.sort(key=lambda r: (r.start, r.tokens))
        at = 0
        for r in rows:
            assert r.start == at  # contiguous from 0: a prefix
            at += r.tokens
        assert at >= give[k] and at - max(r.tokens for r in rows) < give[k]
        for e in {r.epoch for r in rows}:
            ids = [r.doc_id for r in rows if r.epoch == e]
            assert len(ids) - len(set(ids)) <= 1  # one id is on two rows
    assert {k for k, b in give.items() if b} == set(by)
    assert mixing.mix(docs.limit(0), 100, {}, dom).count() == 0


def test_mix_does_not_depend_on_buckets(spark):
    docs = mixed_docs(spark)
    a, b = (sorted(tuple(r) for r in mixing.mix(docs.where("doc_id <> 1"), 20_000, {}, F.lit("d"), rows_per_bucket=n).collect()) for n in (7, 10**6))
    assert a == b


def test_fixity(spark):
    rnd = random.Random(3)
    recs = [(f"f{i % 3}", i * 700, bytes(rnd.randrange(256) for _ in range(50)), 1) for i in range(300)]
    df = spark.createDataFrame([*recs, (None, 5, b"x", 1), ("f1", None, b"y", 1), ("f9", 0, None, 1)], "file string, offset long, record binary, idx int")
    a = warc_fixity.hashed(df)
    assert warc_fixity.audit(a.where("file IS NOT NULL AND offset IS NOT NULL"), a.where("file IS NOT NULL AND offset IS NOT NULL"), 2048).count() == 0
    bad = {recs[5][:2], recs[250][:2]}
    other = [(f, o, d if (f, o) not in bad else d[:-1] + b"!", 1) for f, o, d, _ in recs if (f, o) != recs[100][:2]] + [("f0", 10**7, b"new", 1), ("f9", 0, None, 1)]
    b = warc_fixity.hashed(spark.createDataFrame(other, df.schema))
    got = {(r.file, r.offset, r.status) for r in warc_fixity.audit(a, b, 2048).collect()}
    assert got == {(*x, "differs") for x in bad} | {(*recs[100][:2], "missing_in_b"), ("f0", 10**7, "missing_in_a"), (None, 5, "unplaced"), ("f1", None, "unplaced")}
    empty = a.limit(0)
    assert warc_fixity.audit(empty, empty).count() == 0
    assert warc_fixity.audit(a.where("file = 'f0'"), empty).count() == 100


def test_tree_roots_match_plain_hashing(spark):
    df = spark.createDataFrame([("f", i * 10, bytes([i])) for i in range(5)], "file string, offset long, record binary")
    leaf = [hashlib.sha256(b"\0" + bytes([i])).hexdigest() for i in range(5)]
    assert [r.hash for r in warc_fixity.hashed(df).orderBy("offset").collect()] == leaf
    levels = warc_fixity.tree(warc_fixity.hashed(df), 10, 2)
    assert [t.count() for t in levels] == [5, 1, 1]


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, None, None)], "page_id long, url string, html string")
    data = b"".join(bytes(r.r) for r in pages.orderBy("page_id").select(warc_fixity.record_bytes(F.col("url"), F.col("page_id"), F.col("html")).alias("r")).collect())
    (tmp_path / "a.warc").write_bytes(data)
    got = sorted(warc_fixity.scan(spark, str(tmp_path)).collect(), key=lambda r: r.offset)
    assert [(r.url, bytes(r.content).decode()) for r in got] == [("http://a", "<p>é</p>"), ("", "")]
    assert got[1].offset == got[0].length and sum(r.length for r in got) == len(data)
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc_fixity.parse(b"nonsense"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the generated tables")
def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        x = stage(spark, seen[-1], sf)
        seen.append(spark.createDataFrame(x.collect(), x.schema))
    for s in seen[:-1]:
        assert s.schema.simpleString() == docs.schema.simpleString()
    good, unique, cut, mix, ids = seen[1:]
    assert 0 < unique.count() <= good.count() <= docs.count()
    assert unique.count() == cut.count() and ids.count() == mix.count()
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    from siftmill.llm import jaccard

    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in jaccard.join(good).where("doc_id = component_id").collect()}
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens").collect()) == sorted((r.doc_id, r.n_tokens) for r in ids.collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the generated tables")
def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from siftmill.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        at = [want.columns.index(c) for c in cols]
        assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall()), name
