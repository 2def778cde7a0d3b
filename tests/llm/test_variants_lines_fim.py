"""Fill-in-middle, spelling variants and line dedup against plain Python, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("siftmill.llm")
from siftmill.llm import fim, line_dedup, variants  # noqa: E402

CLASH = "doc_id long, text string, id string, row int, h string, pos string, word string, n double, key string, form int, at string"
EXTRA = ("clash", 1, "h", "p", "w", 2.0, "k", 3, "a")


def table(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], CLASH)


# fill-in-middle


def plain_fim(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    spm = h4 % 100 < 20
    return len(units), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


LONG = "".join(random.Random(1).choice(["Wort ", "é", "日本", "🎉", "letters", "\n", "\x00", "<", "S>"]) for _ in range(40_000)) + "z" * 9000
TEXTS = [None, "", "x", "a b", "<P>", "has <S> and <M>", "<<S><P", "<", "<S", ">", "é" * 3000, "abc" * 5000, "\x00\x00 \x85", "\r\n\r\n", "Ünïcödé — 日本語 🎉🎉", LONG, LONG[:4095] + "é" + LONG[:5000]]


def test_fim_equals_plain_python(spark, monkeypatch):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS * 12)]
    for size, group in ((4096, 2 << 20), (16, 3000)):
        monkeypatch.setattr(fim, "GROUP", group)
        monkeypatch.setattr(fim.pieces, "__defaults__", (size,))
        src = table(spark, rows if size > 100 else [(i, (t or "")[:600]) for i, t in rows]).coalesce(1)
        got = fim.transform(src).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        assert len(got) == len(rows)
        for r, (i, t) in zip(got, src.select("doc_id", "text").collect(), strict=True):
            assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (i, *plain_fim(i, t or ""))
            assert r.back == (t or "")
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_of_an_empty_table(spark):
    assert fim.transform(table(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8), st.integers(4, 9))
def test_pieces_put_together_are_the_texts(texts, size):
    got = fim.pieces(pa.array(texts, pa.string()), size).to_pylist()
    whole = defaultdict(str)
    for r in got:
        assert 0 < len(r["text"].encode()) <= size + 3
        whole[r["row"]] += r["text"]
    assert [whole[i] for i in range(len(texts))] == texts
    assert [r["part"] for r in got if r["row"] == 0] == list(range(sum(r["row"] == 0 for r in got)))


# spelling variants


def one_error(w):
    letters = {c for x in w for c in x}
    for word in w:
        found = set()
        for i in range(len(word) + 1):
            found |= {word[:i] + c + word[i:] for c in letters}
            if i < len(word):
                found |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
        yield word, (found & w.keys()) - {word}


def plain_group(w):
    form, near = {}, {}
    for word, found in one_error(w):
        best = min(found, key=lambda x: (-w[x], x)) if found else None
        near[word], form[word] = len(found), best if best and w[best] >= 2 * w[word] else None
    out = {}
    for word in w:
        root = word
        while form[root]:
            root = form[root]
        out[word] = (form[word], root, w[word], near[word], w[form[word]] if form[word] else None)
    return out


def collected(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_automaton_numbers_and_neighbours():
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(700)})
    a = variants.Automaton(words)
    assert [a._walk(a.root, 0, w) for w in words] == list(range(len(words))) and a._walk(a.root, 0, "abcabcabcabc") == -1
    # as many states as there are different sets of endings
    ends = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(a.final) - 1 == len(ends)
    near = dict(one_error(dict.fromkeys(words, 1)))
    for w in words:
        assert {words[i] for i in a.near(w, 0, len(w))} == near[w]
        assert {words[i] for i in a.near(w, len(w) // 2, len(w))} == {x for x in near[w] if x.startswith(w[: len(w) // 2])}


@pytest.mark.parametrize("group_max", [3, 40, 4000])
def test_group_equals_brute_force(spark, group_max, monkeypatch):
    monkeypatch.setattr(variants, "GROUP_MAX", group_max)
    monkeypatch.setattr(variants, "BUCKET_ROWS", 300)
    rnd = random.Random(group_max)
    w = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 8))): rnd.choice([3, 3, 5, 6, 11, 40]) for _ in range(400)}
    # one half that very many words share, at either end
    w |= {"praefix" + x: n for x, n in list(w.items())[:150]} | {x + "suffixes": n for x, n in list(w.items())[:150]}
    assert collected(variants.group(spark.createDataFrame(list(w.items()), "word string, n long"))) == plain_group(w)


def test_a_half_that_a_third_of_all_words_share(spark, monkeypatch):
    """Groups stay below the bound, and so does what a task gets."""
    monkeypatch.setattr(variants, "GROUP_MAX", 50)
    rnd = random.Random(8)
    w = {"sharedhalf" + "".join(rnd.choice("abcdefgh") for _ in range(10)): 3 for _ in range(1500)}
    w |= {x[:-3] + "z" + x[-2:]: 7 for x in list(w)[:300]}
    assert collected(variants.group(spark.createDataFrame(list(w.items()), "word string, n long"))) == plain_group(w)


def plain_words(rows):
    total = Counter()
    for i, t in rows:
        for x in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            x = re.sub("[A-Z]", lambda m: m[0].lower(), x)
            h = zlib.crc32(f"{'' if i is None else i}:{x}".encode())
            if h % 97 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            total[x] += len(x) >= 5
    return {x: n for x, n in total.items() if n >= 3}


def test_variants_of_odd_texts(spark, monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(variants, "BLOCK", 37)
    monkeypatch.setattr(variants, "COUNTED", 10)
    words = ["Hello", "hello", "hallo", "ÉCOLE", "école", "ecole", "strasse", "straße", "a×b÷c", "word_word", "naïveté", "naïvete", "tiny", "I", "日本語 text", "x" * 200, "x" * 199]
    rows = [(rnd.randrange(60) if k % 9 else None, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for k in range(250)]
    rows += [(1, None), (2, ""), (3, "Hello" * 5000), (3, "Hello" * 5000), (3, "Hello" * 5000), (4, "\n\t .")]
    got = collected(variants.variants(table(spark, rows)))
    assert got == plain_group(plain_words(rows)) and len(got) > 12
    assert variants.variants(table(spark, [])).count() == 0
    assert variants.variants(table(spark, [(None, None), (1, "")])).count() == 0


def test_chains_end_in_their_last_form(spark):
    # each word is twice as frequent as the one before and one letter longer
    w = {"aaaaa" + "b" * k: 3 * 2**k for k in range(11)}
    got = collected(variants.group(spark.createDataFrame(list(w.items()), "word string, n long")))
    assert got == plain_group(w) and {x[1] for x in got.values()} == {"aaaaabbbbbbbbbb"}


# line dedup


def plain_lines(rows, min_chars=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    last = float("inf")
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (last if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def lines_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (6, 2), (9, 3)])
def test_lines_equal_plain_python(spark, batches, fanout):
    rnd = random.Random(batches)
    pool = ["A common line of text", "  a common LINE of text\t", "Été commence ÉTÉ", "été commence ÉTÉ", "short", "exactly10!", "exactly9!", "", " \t\r", "日本語日本語日本語日", "line\x85with next line", "\x0bvertical tabs\x0c", "ǅ titlecase İ letters"]
    pool += [f"line number {k} of the pool" for k in range(150)]
    rows = [(rnd.randrange(80) if k % 11 else None, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(12)))) for k in range(260)]
    rows += [(3, None), (4, ""), (5, "\n\n\n"), (6, "A common line of text"), (6, "A common line of text"), (90, "\n".join(f"line number {k % 150} of the pool" for k in range(20_000)))]
    assert lines_of(line_dedup.dedup(table(spark, rows), batches=batches, fanout=fanout)) == sorted(plain_lines(rows), key=str)


def test_lines_of_string_ids_and_empty_tables(spark):
    rows = [(f"doc-{k:03}" if k % 10 else None, f"shared line {k % 7} of many\nown line of document {k}") for k in range(60)]
    src = spark.createDataFrame(rows, "doc_id string, text string")
    want = [(i, *r) for i, *r in plain_lines([(None if i is None else int(i[4:]), t) for i, t in rows])]
    want = sorted([(None if i is None else f"doc-{i:03}", *r) for i, *r in want], key=str)
    assert lines_of(line_dedup.dedup(src, batches=4)) == want
    assert line_dedup.dedup(table(spark, [])).count() == 0


def test_runs_are_levelled_and_disjoint(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    dropped = []
    for k in range(7):
        batch = spark.createDataFrame([(10 * k + j, 0, j, bytes([j * k % 13, 7])) for j in range(10)], "id long, row long, pos int, h binary")
        dropped += [r.id for r in runs.add(batch).collect()]
        runs.compact()
    assert [len(level) for level in runs.levels] == [1, 1, 1]  # seven batches
    held = [bytes(r.h) for run in runs.runs() for r in run.collect()]
    assert len(held) == len(set(held)) == 13
    first = {}
    for k in range(7):
        for j in range(10):
            first.setdefault(j * k % 13, 10 * k + j)
    assert sorted(dropped) == sorted(10 * k + j for k in range(7) for j in range(10) if first[j * k % 13] != 10 * k + j)


def test_line_dedup_stays_on_the_jvm(spark):
    df = line_dedup.dedup(table(spark, [(1, "one line of some length\nmore"), (2, "one line of some length")]))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|RDD", plan.replace("ExistingRDD", "").replace("LogicalRDD", ""))
