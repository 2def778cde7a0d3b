"""Long conversations, damaged archives, links close to the threshold."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("siftmill.llm")
from siftmill.llm import chat, near_embed, warc_fixity  # noqa: E402


def plain_windows(turns, budget, history):
    """(context turns, new turns) of each window, by going through the turns one by one."""
    tok = [-(-(len(r.encode()) + len(x.encode())) // 4) + 4 for r, x in turns]
    system = tok[0] if turns[0][0] == "system" else 0
    out, first, used = [], 0, 0
    for i, n in enumerate(tok):
        room = budget if not out else max(budget - history - system, 1)
        if i > first and used + n > room:
            out.append((first, i))
            first, used = i, 0
        used += n
    out.append((first, len(turns)))
    done = []
    for w, (a, b) in enumerate(out):
        before = [i for i in range(a) if w and ((i == 0 and system) or sum(tok[i:a]) <= history)]
        done.append((before, list(range(a, b))))
    return done


@pytest.mark.parametrize(("budget", "history"), [(120, 40), (60, 60), (1, 0), (400, 390)])
def test_windows_one_turn_at_a_time(spark, budget, history, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 7)
    rnd = random.Random(budget)
    convs = {c: [("system" if c % 2 and not i else rnd.choice(["user", "assistant"]), "é" * rnd.randrange(0, 120)) for i in range(rnd.randrange(1, 90))] for c in range(12)}
    rows = [(c, i, r, x) for c, ts in convs.items() for i, (r, x) in enumerate(ts)]
    got = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget, history).collect()
    seen = {(r.conv_id, r.window): r for r in got}
    assert len(seen) == len(got) == sum(len(plain_windows(ts, budget, history)) for ts in convs.values())
    for c, ts in convs.items():
        for w, (before, new) in enumerate(plain_windows(ts, budget, history)):
            r = seen[c, w]
            assert (r.n_context, r.n_new) == (len(before), len(new))
            assert r.formatted == "".join(f"{chat.START}{ts[i][0]}\n{ts[i][1]}{chat.END}" for i in before + new)
            assert [r.formatted[x.start : x.stop] for x in r.loss] == [ts[i][1] for i in new if ts[i][0] == "assistant"]


def test_a_conversation_of_very_many_turns(spark):
    """Time and memory follow the turns: windows are not multiplied with turns."""
    n = 30_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit(" word"), 20)).alias("text"))
    back = chat.read_back(chat.format_windows(turns, 1024, 192)).first()
    assert back.n_turns == n and back.turns[n - 1].text.startswith(f"text {n - 1} ")


def test_damaged_archives_are_reported(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * 50) for i in range(4)], "page_id long, url string, html string")
    recs = [bytes(r.r) for r in pages.orderBy("page_id").select(warc_fixity.record_bytes(F.col("url"), F.col("page_id"), F.col("html")).alias("r")).collect()]
    data = b"".join(recs)
    (tmp_path / "whole.warc").write_bytes(data)
    (tmp_path / "cut.warc").write_bytes(data[:-20])
    (tmp_path / "noise.warc").write_bytes(recs[0] + b"noise\r\n\r\n" + recs[1])
    (tmp_path / "length.warc").write_bytes(recs[0] + recs[1].replace(b"Content-Length: 50", b"Content-Length: 12") + recs[2])
    (tmp_path / "gz.warc").write_bytes(b"".join(map(gzip.compress, recs)))
    (tmp_path / "gzcut.warc").write_bytes(b"".join(map(gzip.compress, recs))[:-15])
    by = {}
    for r in warc_fixity.scan(spark, str(tmp_path)).collect():
        by.setdefault(r.file, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: (r.offset, r.length))
    urls = lambda f: [r.url for r in by[f] if not r.error]
    errors = lambda f: [r.error for r in by[f] if r.error]
    every = [f"http://a/{i}" for i in range(4)]
    assert urls("whole.warc") == urls("gz.warc") == every and not errors("whole.warc") and not errors("gz.warc")
    assert urls("cut.warc") == every[:3] and errors("cut.warc") == ["cut off"]
    assert urls("noise.warc") == every[:2] and errors("noise.warc") == ["no WARC record"]
    assert urls("length.warc") == [every[0], every[2]] and errors("length.warc") == ["the content length is wrong"]
    assert urls("gzcut.warc")[:3] == every[:3] and "gzip: cut off" in errors("gzcut.warc")
    assert sum(r.length for r in by["noise.warc"]) == len(recs[0] + b"noise\r\n\r\n" + recs[1])
    whole = warc_fixity.scan(spark, str(tmp_path)).where("file = 'whole.warc'").select("file", "offset", F.col("content").alias("record"))
    assert warc_fixity.audit(warc_fixity.hashed(whole), warc_fixity.hashed(whole)).count() == 0


def test_links_close_to_the_threshold(spark):
    """Every planted pair just above 0.98 is found, none just below."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(150):
        u, w = rng.normal(size=(2, 32))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        c = 0.98 + (1e-6 if i % 2 else -1e-6)
        rows += [(2 * i, (3 * u).tolist(), "a"), (2 * i + 1, (c * u + np.sqrt(1 - c * c) * w).tolist(), "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_embed.near_duplicates(df, miss=1e-7).collect()}
    for i in range(150):
        linked = i % 2
        assert got[2 * i] == (linked, 2 * i) and got[2 * i + 1] == (linked, 2 * i if linked else 2 * i + 1)
    assert near_embed.sketch_limit(0.98, 1e-6) < 60


def test_copies_of_one_vector_are_counted_not_paired(spark):
    one = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(x)) for x in (1, 2, 3)]).alias("embedding"), F.lit("a").alias("label"))
    got = near_embed.near_duplicates(one).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(19_999, 0, 20_000)]
