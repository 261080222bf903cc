"""Word wrap and font fitting with a measure of widths; the default measure is a font of equal advances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

LEAST, MOST, SPACING = 12, 100, 0.42
Measure = Callable[[Column, Column], Column]


def text_width(t: Column, size: Column) -> Column:
    """Three fifths of the size for each character."""
    return F.floor(F.length(t) * size * 3 / 5).cast("int")


def text_height(t: Column, size: Column) -> Column:
    return size.cast("int")


def line_spacing(size: Column) -> Column:
    return F.least(F.lit(LEAST + 2).cast("double"), size * SPACING)


def wrap(t: Column, size: Column, width: Column, measure: Measure = text_width) -> Column:
    """Lines filled word by word; a word wider than the box has a line of its own and isn't cut; no words, one empty line."""
    w = words(t)
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.coalesce(F.get(w, 0), F.lit("")).alias("now"))

    def step(state: Column, word: Column) -> Column:
        longer = F.concat(state["now"], F.lit(" "), word)
        over = measure(longer, size) > F.greatest(F.lit(1), width)
        return F.when(over, F.struct(F.concat(state["lines"], F.array(state["now"])).alias("lines"), word.alias("now"))).otherwise(
            F.struct(state["lines"].alias("lines"), longer.alias("now"))
        )

    rest = F.slice(w, F.lit(2), F.greatest(F.lit(0), F.size(w) - 1))
    return F.aggregate(rest, start, step, lambda s: F.concat(s["lines"], F.array(s["now"])))


def paragraph_height(lines: Column, size: Column) -> Column:
    """Line heights and the spaces between lines; lines of one size are equally high."""
    return F.size(lines) * text_height(F.lit(""), size) + F.greatest(F.lit(0), F.size(lines) - 1) * line_spacing(size)


def fits(t: Column, size: Column, width: Column, height: Column, measure: Measure = text_width) -> Column:
    lines = wrap(t, size, width, measure)
    return (paragraph_height(lines, size) <= height) & (F.array_max(F.transform(lines, lambda x: measure(x, size))) <= width)


def font_size(t: Column, width: Column, height: Column, measure: Measure = text_width) -> Column:
    """The last size, from the least one up, before the first that doesn't fit; the least even if it doesn't fit."""
    start = F.struct(F.lit(LEAST).alias("size"), F.lit(True).alias("go"))

    def step(state: Column, size: Column) -> Column:
        return F.when(state["go"] & fits(t, size, width, height, measure), F.struct(size.alias("size"), F.lit(True).alias("go"))).otherwise(
            F.struct(state["size"].alias("size"), F.lit(False).alias("go"))
        )

    return F.aggregate(F.sequence(F.lit(LEAST), F.lit(MOST)), start, step, lambda s: s["size"])


def place_lines(lines: Column, size: Column, x: Column, y: Column, w: Column, h: Column, measure: Measure = text_width) -> Column:
    """Where each line goes: centred across and the paragraph centred down the box, never outside its top or left."""
    top = y + F.greatest(F.lit(0.0), (h - paragraph_height(lines, size)) / 2)
    return F.transform(
        lines,
        lambda line, i: F.struct(
            line.alias("line"),
            (x + F.greatest(F.lit(0), F.floor((w - measure(line, size)) / 2))).cast("int").alias("x"),
            (top + i * (text_height(line, size) + line_spacing(size))).alias("y"),
        ),
    )
