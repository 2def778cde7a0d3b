"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from siftmill.functions import hashing, language, ocr, rules, titles, uris


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "want"), [("ffff", "fffe", 1), ("FFFF", "ffff", 0), ("ff", "fff", None), ("f" * 24 + "0", "0" + "f" * 23 + "e", 7), ("", "", None), ("zz", "zz", None)])
def test_hamming_any(spark, a, b, want):
    assert one(spark, hashing.hamming_any(F.col("a"), F.col("b")), a=a, b=b) == want


def test_hamming_fixed(spark):
    h = hashing.hamming(F.col("a"), F.col("b"))
    assert one(spark, h, a="F" * 25, b="f" * 24 + "e") == 1
    assert one(spark, h, a="f" * 25, b="f" * 24) is None


def test_catalog_parts(spark):
    p = one(spark, uris.catalog_parts(F.col("u")), u="archive://a/b.zip!/p/x.jpg")
    assert (p.filename, p.file_extension, p.base_uri, p.archive_name, p.source_type) == ("p/x.jpg", ".jpg", "archive://a/b.zip!/p/x", "b.zip", "archive")
    p = one(spark, uris.catalog_parts(F.col("u")), u="archive:///d/Dir A.zip!s/1.avif")
    assert (p.filename, p.base_uri, p.archive_name) == ("s/1.avif", "archive:///d/Dir A.zip!s/1", "Dir A.zip")
    p = one(spark, uris.catalog_parts(F.col("u")), u="/local/path/image.jpg")
    assert (p.filename, p.base_uri, p.source_type) == ("image.jpg", "/local/path/image", "file")


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/d/merged_17.zip!Dir A/s/1.avif", "archive:////d/Dir A.zip!s/1.avif"),
        ("/d/x.zip!a\\b.jpg", "archive:////d/x.zip!a/b.jpg"),
        ("/d/x.jpg", "file:////d/x.jpg"),
    ],
)
def test_canonical(spark, path, want):
    assert one(spark, uris.canonical(F.col("p")), p=path) == want


def test_paths(spark):
    assert one(spark, uris.extension(F.col("p")), p="/a/.png") == ""
    assert one(spark, uris.extension(F.col("p")), p="/a.b/c.TXT") == ".txt"
    assert one(spark, uris.relative_to(F.col("p"), F.lit("/a")), p="/a/b/c") == "b/c"
    assert one(spark, uris.strip_quotes(F.col("p")), p=' "x y" ') == "x y"
    assert one(spark, uris.resolve_virtual(F.col("p")), p="漫画A[汉化].folderzip") == "漫画A[汉化]"
    p = one(spark, uris.display_parts(F.col("u")), u="archive:///E:/d.zip!folder/image.JPG")
    assert (p.filename, p.file_format, p.archive_name) == ("image.JPG", "jpg", "d.zip")
    assert one(spark, uris.original_path(F.col("u")), u="file:////a%20b/c.jpg") == "/a b/c.jpg"


def test_titles(spark):
    assert one(spark, titles.title_key(F.col("n")), n="[Circle] My Book (Event) {12@PX} v2.zip") == "mybookv2"
    assert one(spark, titles.title_key(F.col("n"), True), n="漫画 A!.zip") == "漫画a"
    assert one(spark, titles.version(F.col("n")), n="Book v3") == 3
    assert one(spark, titles.version(F.col("n")), n="Book") is None
    assert one(spark, titles.without_version(F.col("n")), n="Book v3") == "Book"
    assert one(spark, titles.without_hash_tag(F.col("n")), n="a[hash-1fA].jpg") == "a.jpg"
    assert one(spark, titles.group_tag(F.col("n")), n="[x] b [某汉化组].zip") == "某汉化组"
    assert tuple(one(spark, titles.metrics_of(F.col("n")), n="a{120@PX,1800@WD,1.8k@DE}.zip")) == (1800, 120, 0.0)
    assert one(spark, titles.without_metric_tag(F.col("n")), n="a{12@PX}.zip") == "a.zip"
    assert one(spark, titles.metric_tag(F.lit(1800), F.lit(120), F.lit(0))) == "{1.8k@WD,120@PX}"
    assert one(spark, titles.with_language_suffix(F.col("n"), F.lit("_zh")), n="a_zh.jpg") == "a_zh.jpg"
    assert one(spark, titles.width_in_name(F.col("n")), n="a[1234px].zip") == 1234


@pytest.mark.parametrize(("n", "want"), [(999, "999"), (10000, "1w"), (35000, "3.5w"), (350000000, "3.5亿"), (1000, "1k")])
def test_short_number(spark, n, want):
    assert one(spark, titles.short_number(F.col("n")), n=n) == want


def test_sizes(spark):
    assert one(spark, titles.file_size(F.col("n")), n=0) == "0 B"
    assert one(spark, titles.file_size(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, titles.short_number(F.col("n"), by_ten_thousands=False), n=2500000) == "2.5M"


@pytest.mark.parametrize(("text", "want"), [("これはテストです", "japanese"), ("汉化组翻译", "chinese"), ("hello world", "english"), ("ab", "unknown"), ("", "unknown"), ("12345 67890", "unknown")])
def test_heuristic(spark, text, want):
    assert one(spark, language.heuristic(F.col("t")), t=text) == want


def test_scripts(spark):
    assert one(spark, language.by_script(F.col("t")), t="漢字かな") == "chinese"
    assert one(spark, language.by_script(F.col("t")), t="123") == "unknown"
    assert one(spark, language.is_traditional(F.col("t")), t="漢譯") is True
    assert "漢化" in language.keyword_variants(["汉化"])


def test_rules(spark):
    h = lambda w, x: one(spark, rules.is_small(F.lit(w), F.lit(x)))
    assert h(1, 630) is True and h(1, 629) is False
    assert one(spark, rules.is_small_content(F.lit(629), F.lit(700))) is True
    r = [rules.DimensionRule("a", 0, 900), rules.DimensionRule("b", 901, 1800)]
    assert one(spark, rules.first_rule(F.lit(800), F.lit(1), r)) == 0
    assert one(spark, rules.DimensionRule("x", 5, 6, -1, 10, "or").matches(F.lit(100), F.lit(7))) is True
    assert one(spark, rules.is_ad(F.col("n")), n="招募1.jpg") is True
    assert one(spark, rules.is_ad(F.col("n")), n="招募1.txt") is False
    assert one(spark, rules.is_ad(F.col("n")), n="zzz.png") is True
    assert one(spark, rules.is_blacklisted(F.col("n")), n="/x/CG集/a") is True
    assert one(spark, rules.has_watermark(F.array(F.lit("a"), F.lit("招募翻译")))) is True


def test_ocr(spark):
    box = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((0, 0), (10, 0), (10, 10), (0, 10))])
    d = one(spark, ocr.text_density(F.array(F.struct(F.lit("abc").alias("text"), box.alias("box"))), F.lit(100), F.lit(100)))
    assert (d.text_area, d.text_density, d.text_count) == (100.0, 0.01, 3)
    blocks = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(float(y)).alias("y")) for t, y in (("b", 8), ("a", 0), ("c", 16))])
    assert one(spark, ocr.group_lines(blocks)) == ["a b", "c"]
    assert one(spark, ocr.clean_lines(F.lit("x\n\n[INFO] y\nz"))) == ["x", "z"]
    assert one(spark, hashing.hash_params(F.lit("hash_size=10;hash_version=1"))) == {"hash_size": "10", "hash_version": "1"}


def test_versions_end_a_title(spark):
    want = {"Bookv3": 3, "Book v2 extra": None, "Book (v4)": 4, "a [V12]": 12, "v7": 7, "Book_v05": 5, "Book": None, "v1 v2": 2, "Book v": None, "": None, None: None}
    for stem, n in want.items():
        assert one(spark, titles.version(F.col("t")), t=stem) == n, stem
    bare = {"Bookv3": "Bookv3", "Book v2 extra": "Book v2 extra", "Book (v4)": "Book", "a [V12]": "a", "Book_v05": "Book", "x - v2": "x -", None: None}
    for stem, rest in bare.items():
        assert one(spark, titles.without_version(F.col("t")), t=stem) == rest, stem


def test_forms_of_han_characters(spark):
    found = language.keyword_variants(["无邪气", "新视界", "绅士仓库", "机翻", "夢之行蹤", "DL版"])
    assert {"無邪氣", "新視界", "紳士倉庫", "機翻", "梦之行踪", "dl版"} <= set(found)
    assert len(language.character_forms()[0]) > 2000
    assert one(spark, language.is_traditional(F.col("t")), t="紳士倉庫與書") is True
    assert one(spark, language.is_traditional(F.col("t")), t="绅士仓库与书") is False
    assert one(spark, language.is_traditional(F.col("t")), t="") is False


def test_languages_of_mixed_scripts(spark):
    """Scripts and the heuristic against plain Python, on texts of Han, kana, Latin, marks and particles."""
    import random
    import re

    rnd = random.Random(5)
    parts = ["漢字", "中文", "の", "です", "カナ", "ひら", "abc", "word ", "「", "！", " ", "\n", "12", "𠀋", "もの", "é"]
    texts = ["".join(rnd.choices(rnd.sample(parts, rnd.randrange(1, 7)), k=rnd.randrange(0, 14))) for _ in range(400)] + [None, "", "  "]
    plain = lambda p: re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), p)
    han, basic, kana, more, marks = map(plain, (language.HAN_WIDE, language.HAN_BASIC, language.KANA, language.KANA_AND_EXTENSION, language.JAPANESE_MARKS))

    def script(t):
        c, j, e = (len(re.findall(p, t or "")) for p in (basic, more, language.LATIN))
        return "unknown" if not c + j + e else "chinese" if c >= j and c >= e else "japanese" if j >= e else "english"

    def mixed(t):
        t = re.sub(r"\s+", "", t or "")
        c, k, e, n = (len(re.findall(p, t)) for p in (han, kana, language.LATIN, language.JAPANESE_PARTICLES))
        seen = k + 2 * len(re.findall(marks, t)) + 4 * n
        if k >= 1 and (k >= 2 and 100 * k >= 3 * (c + k) or seen >= 6 or n >= 2):
            who, much = "japanese", k
        elif c and 10 * c >= 3 * (c + e) and c >= e or c == max(c, k, e):
            who, much = "chinese", c
        else:
            who, much = ("english", e) if e == max(c, k, e) else ("japanese", k)
        return who if len(t) >= 5 and c + k + e and much >= 3 and 2 * much >= len(t) else "unknown"

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", language.by_script(F.col("t")).alias("s"), language.heuristic(F.col("t")).alias("h")).collect():
        assert (r.s, r.h) == (script(r.t), mixed(r.t)), r.t


def test_excluded_words(spark):
    for path, part, whole in [("a/My-Trash_1/x.zip", True, True), ("a/trashy/x.zip", True, False), ("a/x.trash", True, True), ("a/b", False, False), (None, None, None)]:
        assert one(spark, rules.excluded_path(F.col("t"), ["Trash"]), t=path) is part
        assert one(spark, rules.excluded_path(F.col("t"), ["Trash"], whole=True), t=path) is whole
