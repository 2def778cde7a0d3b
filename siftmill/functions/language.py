"""Script and language of short texts as column expressions."""

from __future__ import annotations

from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and words of the heuristic.
HAN_WIDE = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]"
KANA = r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}]"
LATIN = r"[A-Za-z]"
JAPANESE_MARKS = "[「」『』【】〈〉《》〔〕（）。？！…～・ー＝：；＋＊★☆※→⇒◎◇◆△▽▼▲○●❖■□“”]"
JAPANESE_PARTICLES = "の|です|ます|でした|ません|して|した|してい|してる|ない|たい|だった|から|けど|けれど|ても|もの|こと|よう|では|には|って"
HAN_BASIC = r"[\x{4e00}-\x{9fff}]"
KANA_AND_EXTENSION = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}]"
MIN_TOTAL, MIN_COUNT, MIN_SHARE = 5, 3, 0.5

_count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))


def _chars(text: Column, one: str) -> Column:
    """How many characters are of a class: by what is left without them, as runs go at once and no match is kept."""
    return F.length(text) - F.length(F.regexp_replace(text, one + "+", ""))


def _let(value: Column, f) -> Column:
    """f(value), with `value` evaluated once however often f names it."""
    return F.transform(F.array(value), f)[0]


def by_script(text: Column) -> Column:
    """The script with most characters: chinese, japanese or english, in this order at a tie; unknown without any."""

    def named(x: Column) -> Column:
        c, j, e = x["c"], x["j"], x["e"]
        return F.when(c.isNull() | (c + j + e == 0), "unknown").when((c >= j) & (c >= e), "chinese").when(j >= e, "japanese").otherwise("english")

    return _let(F.struct(_chars(text, HAN_BASIC).alias("c"), _chars(text, KANA_AND_EXTENSION).alias("j"), _chars(text, LATIN).alias("e")), named)


def heuristic(text: Column, min_total: int = MIN_TOTAL, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE) -> Column:
    """Language of a text that may mix Han, kana and Latin letters.

    Japanese, where kana is enough evidence by its share, by marks and particles with it, or by particles alone;
    else Chinese, where Han is 30 % of Han and Latin and no less than Latin; else whatever has most characters. The
    winner needs `min_count` characters and `min_share` of all that are not white space. Null is unknown.
    """

    def counts(t: Column) -> Column:
        # particles and marks only count beside kana
        kana = _chars(t, KANA)
        beside = lambda c: F.when(t.rlike(KANA), c).otherwise(0)
        return F.struct(
            F.length(t).alias("size"), _chars(t, HAN_WIDE).alias("c"), kana.alias("k"), _chars(t, LATIN).alias("e"),
            beside(_chars(t, JAPANESE_MARKS)).alias("marks"), beside(_count(t, JAPANESE_PARTICLES)).alias("particles"),
        )

    def named(x: Column) -> Column:
        size, c, k, e = x["size"], x["c"], x["k"], x["e"]
        evidence = k + 2 * x["marks"] + 4 * x["particles"]
        japanese = (k >= 1) & (((k >= 2) & (100 * k >= 3 * (c + k))) | (evidence >= 6) | (x["particles"] >= 2))
        chinese = (c > 0) & (10 * c >= 3 * (c + e)) & (c >= e)
        most = F.greatest(c, k, e)
        winner = F.when(japanese, "japanese").when(chinese | (c == most), "chinese").when(e == most, "english").otherwise("japanese")
        count = F.when(winner == "japanese", k).when(winner == "chinese", c).otherwise(e)
        enough = (size >= min_total) & (c + k + e > 0) & (count >= min_count) & (count >= min_share * size)
        return F.when(F.coalesce(enough, F.lit(False)), winner).otherwise("unknown")

    return _let(_let(F.regexp_replace(text, r"(?U)\s+", ""), counts), named)


def detect(text: Column, library: Column | None = None) -> Column:
    """What an outside detector says (`library`, a column; only zh, ja and en count), else the heuristic."""
    own = heuristic(text)
    if library is None:
        return own
    said = F.when(library.isin("zh", "chinese"), "chinese").when(library.isin("ja", "japanese"), "japanese").when(library.isin("en", "english"), "english")
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "unknown").otherwise(F.coalesce(said, own))


def language_suffix(language: Column) -> Column:
    return F.when(language == "chinese", "_zh").when(language == "english", "_en").when(language == "japanese", "_ja").otherwise("_unk")


@cache
def character_forms() -> tuple[dict[int, str], dict[int, str]]:
    """(simplified to traditional, traditional to simplified), for str.translate: every Han character that has another form.

    Made from the transliteration rules of the ICU library that Spark brings along; needs a running session.
    """
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("a Spark session must run")
    chars = [*map(chr, range(0x3400, 0x4DC0)), *map(chr, range(0x4E00, 0xA000))]
    forms = []
    for rule in ("Simplified-Traditional", "Traditional-Simplified"):
        other = context._jvm.com.ibm.icu.text.Transliterator.getInstance(rule).transliterate("\n".join(chars)).split("\n")
        forms.append({ord(a): b for a, b in zip(chars, other, strict=True) if a != b})
    return forms[0], forms[1]


def is_traditional(text: Column) -> Column:
    """More than 5 % of the characters have a simplified form."""
    traditional = "".join(map(chr, character_forms()[1]))
    changed = F.length(text) - F.length(F.translate(text, traditional, ""))
    return F.when(F.length(text) > 0, changed > F.length(text) * 0.05).otherwise(False)


def keyword_variants(words: list[str]) -> list[str]:
    """Words, their traditional and their simplified forms, lower case, each once."""
    to_t, to_s = character_forms()
    return sorted({v.lower() for w in words for v in (w, w.translate(to_t), w.translate(to_s))})


def replacement_share_ok(text: Column, limit: float = 0.2) -> Column:
    """Whether less than `limit` of a decoded name are replacement characters."""
    return F.when(F.length(text) > 0, _count(text, "�") < F.length(text) * limit).otherwise(False)


def without_replacements(text: Column) -> Column:
    return F.replace(text, F.lit("�"), F.lit(""))
