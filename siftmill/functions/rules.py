"""Predicates of the curation rules as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.language import keyword_variants

# Keyword lists.
CHINESE_VERSION = [
    "汉化", "漢化", "翻译", "翻訳", "翻譯", "中国翻译", "中国翻訳", "中国語", "chinese", "中文", "中国", "嵌字", "掃圖", "掃", "制作", "製作", "重嵌",
    "个人", "去码", "日语社", "机翻", "赞助", "汉", "漢", "数位", "未来数位", "新视界", "出版", "青文出版", "脸肿", "无毒", "空気系", "夢之行蹤",
    "萌幻鴿鄉", "绅士仓库", "Lolipoi", "靴下", "CE家族社", "不可视", "一匙咖啡豆", "无邪气", "洨五", "白杨", "瑞树", "冊語草堂", "淫书馆", "是小狐狸哦",
    "工房", "工坊", "基地", "汉化组", "漢化組", "汉化社", "漢化社", "CE 家族社", "个人汉化", "個人漢化",
]
ORIGINAL_VERSION = [
    "Digital", "DL版", "DL", "デジタル版", "出版", "出版社", "書店版", "通常版", "無修正", "无修正", "无修", "無修", "完全版", "完整版", "全彩", "官方",
    "カラー", "彩色", "彩色版",
]
BLACKLIST = [
    "trash", "画集", "畫集", "artbook", "art book", "art works", "illustrations", "图集", "圖集", "illust", "collection", "杂图", "雜圖", "杂图合集",
    "雜圖合集", "pixiv", "fanbox", "gumroad", "twitter", "待分类", "待處理", "待分類", "图包", "圖包", "图片", "圖片", "cg", "02cos",
]
WATERMARK = [
    "汉化", "翻译", "扫描", "嵌字", "组", "漢化", "扫图", "校对", "润色", "招募", "公众号", "众筹", "关注", "有偿", "福利", "二维", "淘宝", "免费",
]
AD_KEYWORDS = ["招募", "credit", "广告", "宣传", "招新", "绅士快乐", "粉丝群", "無邪気", "testeng"]
AD_PATTERNS = [r"[Cc]redit[s]", r"ver\.\d+\.\d+", r"YZv\.\d+\.\d+", r"z{3,}"]
AD_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".avif", ".jxl", ".tiff", ".tif"]
RESCAN = "別スキャン"
MIN_SIZE = 630


def has_keyword(text: Column, words: list[str], variants: bool = True) -> Column:
    """Whether the text, lower case, holds any of the words (with traditional and simplified forms); null holds none."""
    found = keyword_variants(words) if variants else sorted({w.lower() for w in words})
    return F.coalesce(F.lower(text).rlike("|".join(map(re.escape, found))), F.lit(False)) if found else F.lit(False)


def is_chinese_version(name: Column) -> Column:
    return has_keyword(name, CHINESE_VERSION)


def is_original_version(name: Column) -> Column:
    return has_keyword(name, ORIGINAL_VERSION)


def is_blacklisted(path: Column) -> Column:
    return has_keyword(path, BLACKLIST)


def is_rescan(name: Column) -> Column:
    return F.coalesce(name.contains(RESCAN), F.lit(False))


def is_ad(name: Column, keywords: list[str] = AD_KEYWORDS, patterns: list[str] = AD_PATTERNS, extensions: list[str] = AD_EXTENSIONS) -> Column:
    """An image whose name holds a keyword, in this very spelling, or matches a pattern."""
    image = F.lower(name).rlike("(?:" + "|".join(map(re.escape, extensions)) + ")$")
    return F.coalesce(image & name.rlike("|".join([*map(re.escape, keywords), *patterns])), F.lit(False))


def excluded_path(path: Column, words: list[str], whole: bool = False) -> Column:
    """Whether any part of the path holds any of the words, lower case; with `whole`, as a word between spaces, `-`, `_` and `.`."""
    lows = F.array(*[F.lit(w.lower().strip()) for w in words])
    if whole:
        return F.arrays_overlap(F.split(F.lower(path), r"[/\\\s\-_.]+"), lows)
    return F.exists(F.split(F.lower(path), r"[/\\]"), lambda p: F.exists(lows, lambda w: p.contains(w)))


def is_small(width: Column, height: Column, size: int = MIN_SIZE, width_range: tuple | None = None, height_range: tuple | None = None) -> Column:
    """The file predicate: height equal to `size` where no range is given, else width or height in its range."""
    if width_range is None and height_range is None:
        return height == size
    parts = [c.between(*r) for c, r in ((width, width_range), (height, height_range)) if r is not None]
    return parts[0] if len(parts) == 1 else parts[0] | parts[1]


def is_small_content(width: Column, height: Column, size: int = MIN_SIZE) -> Column:
    """The content predicate: width or height below `size`."""
    return (width < size) | (height < size)


@dataclass(frozen=True)
class DimensionRule:
    """Bounds of -1 are open. mode `and`: both sides fit; `or`: one does."""

    folder: str
    min_width: int = -1
    max_width: int = -1
    min_height: int = -1
    max_height: int = -1
    mode: str = "and"

    def matches(self, width: Column, height: Column) -> Column:
        def fits(c: Column, lo: int, hi: int) -> Column:
            return (F.lit(lo == -1) | (c >= lo)) & (F.lit(hi == -1) | (c <= hi))

        w, h = fits(width, self.min_width, self.max_width), fits(height, self.min_height, self.max_height)
        return w & h if self.mode == "and" else w | h


def first_rule(width: Column, height: Column, rules: list[DimensionRule]) -> Column:
    """Index of the first rule that matches; null for none."""
    return F.coalesce(*[F.when(r.matches(width, height), F.lit(i)) for i, r in enumerate(rules)])


def watermark_lines(lines: Column, words: list[str] = WATERMARK) -> Column:
    """The lines of recognised text that hold any of the words; an empty array where there are none, or no lines."""
    kept = F.filter(lines, lambda x: F.exists(F.array(*map(F.lit, dict.fromkeys(words))), lambda w: x.contains(w)))
    return F.coalesce(kept, F.array().cast("array<string>"))


def has_watermark(lines: Column, words: list[str] = WATERMARK) -> Column:
    return F.size(watermark_lines(lines, words)) > 0


def has_excluded_format(members: Column, formats: tuple[str, ...] = (".gif", ".mp4", ".webm", ".mkv", ".mov")) -> Column:
    return F.exists(members, lambda m: F.lower(m).rlike("(?:" + "|".join(map(re.escape, formats)) + ")$"))


def is_wanted_dir(path: Column, words: tuple[str, ...] = ("trash", "multi")) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & ~F.lower(path).contains(w)
    return out
