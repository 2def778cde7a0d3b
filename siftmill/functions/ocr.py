"""Recognised text boxes and lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_GAP = 10


def box_area(box: Column) -> Column:
    """Area of array<array<double>>: a polygon of four points, or [[x1, y1], [x2, y2]]; 0 for anything else."""
    x, y = (lambda i: box[i][0]), (lambda i: box[i][1])
    four = 0.5 * F.abs(x(0) * (y(1) - y(3)) + x(1) * (y(2) - y(0)) + x(2) * (y(3) - y(1)) + x(3) * (y(0) - y(2)))
    two = F.abs(x(1) - x(0)) * F.abs(y(1) - y(0))
    return F.coalesce(F.when(F.size(box) == 4, four).when(F.size(box) == 2, two), F.lit(0.0))


def text_density(blocks: Column, width: Column, height: Column) -> Column:
    """struct<text_count, text_area, image_area, text_density, char_density> of array<struct<text, box>>; zeros without blocks."""
    blocks = F.coalesce(blocks, F.array().cast("array<struct<text:string,box:array<array<double>>>>"))
    area = width.cast("double") * height.cast("double")
    count = F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + F.coalesce(F.length(b["text"]), F.lit(0)).cast("long"))
    covered = F.aggregate(blocks, F.lit(0.0), lambda s, b: s + box_area(b["box"]))
    share = lambda v: F.when(area > 0, v / area).otherwise(0.0)
    return F.struct(count.alias("text_count"), covered.alias("text_area"), area.alias("image_area"), share(covered).alias("text_density"), share(count * 1000.0).alias("char_density"))


def group_lines(blocks: Column, gap: float = LINE_GAP) -> Column:
    """array<string> of lines of array<struct<text, y>>: sorted by y, a block joins a line while it is within `gap` of the line's first."""
    rows = F.array_sort(F.transform(blocks, lambda b: F.struct(b["y"].cast("double").alias("y"), b["text"].alias("text"))))
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<array<string>>").alias("lines"))

    def add(s: Column, b: Column) -> Column:
        joins = s["y"].isNotNull() & (F.abs(b["y"] - s["y"]) <= gap)
        n = F.size(s["lines"])
        grown = F.concat(F.slice(s["lines"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(s["lines"], n), F.array(b["text"]))))
        return F.when(joins, F.struct(s["y"].alias("y"), grown.alias("lines"))).otherwise(F.struct(b["y"].alias("y"), F.concat(s["lines"], F.array(F.array(b["text"]))).alias("lines")))

    return F.transform(F.aggregate(rows, zero, add)["lines"], lambda parts: F.array_join(parts, " "))


def clean_lines(text: Column) -> Column:
    """The lines that are neither blank nor log output of a recogniser."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(?:\[|【)?(?:INFO|WARN|ERROR|DEBUG)\b"))


def aggregate_text(blocks: Column) -> Column:
    """All non-empty texts, joined by spaces."""
    return F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda x: x != ""), " ")
