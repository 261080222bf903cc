"""Rectangles on pages: bounds, masks, merging of what nearly touches, reading order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .graph import components

PADDING, BAND = 15, 50
#: Boxes of a page up to which they are compared in one batch.
PAGE_BOXES = 500


def bounding_box(quad: Column) -> Column:
    """x, y and inclusive width and height of a polygon's points."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x + 1).alias("w"), (F.array_max(ys) - y + 1).alias("h"))


def mask_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, grow: int = 1) -> Column:
    """The pixels a detection masks, first and last included: a pixel more on each side, within the page."""
    return F.struct(
        F.greatest(F.lit(0), x - grow).alias("x1"),
        F.greatest(F.lit(0), y - grow).alias("y1"),
        F.least(width - 1, x + w - 1 + grow).alias("x2"),
        F.least(height - 1, y + h - 1 + grow).alias("y2"),
    )


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, padding: int = PADDING) -> Column:
    """Half-open bounds of the part of the page around a region that is read."""
    return F.struct(
        F.greatest(F.lit(0), x - padding).alias("x1"),
        F.greatest(F.lit(0), y - padding).alias("y1"),
        F.least(width, x + w + padding).alias("x2"),
        F.least(height, y + h + padding).alias("y2"),
    )


def kernel(width: Column, height: Column, japanese: Column) -> Column:
    """The size of the box by which masks grow together: halves are rounded to even, one pixel at least."""
    kh = F.bround(F.when(japanese, height * 0.003215).otherwise(height * 0.005))
    kw = F.bround(F.when(japanese, width * 0.003215).otherwise(width * 0.03))
    return F.struct(F.greatest(F.lit(1), kh.cast("int")).alias("h"), F.greatest(F.lit(1), kw.cast("int")).alias("w"))


def shrink(size: Column, factor: float = 0.75) -> Column:
    """What is left of a side after a memory error."""
    return F.greatest(F.lit(1), F.floor(size * factor).cast("int"))


def fit_size(width: Column, height: Column, most: int, stride: int | None = None, enlarge: bool = True) -> Column:
    """Sides with the same proportions inside a square of ``most``: rounded half to even, and up to a multiple of ``stride``."""
    r = F.least(most / height, most / width)
    r = r if enlarge else F.least(r, F.lit(1.0))
    side = lambda n: F.bround(n * r).cast("int")
    up = lambda n: (F.ceil(n / stride) * stride).cast("int") if stride else n
    return F.struct(up(side(width)).alias("w"), up(side(height)).alias("h"))


def print_size(width: Column, height: Column, page_width: int, page_height: int) -> Column:
    """A picture on a printed page: over its full width if it is wider than high, else over its full height."""
    aspect = width / height
    wide = F.struct(F.lit(page_width).alias("w"), F.floor(page_width / aspect).cast("int").alias("h"))
    return F.when(aspect > 1, wide).otherwise(F.struct(F.floor(page_height * aspect).cast("int").alias("w"), F.lit(page_height).alias("h")))


def dilate(box: Column, k: Column, width: Column, height: Column) -> Column:
    """Inclusive bounds after growing by a kernel whose anchor is its middle, rounded down."""
    before = lambda n: n - 1 - F.floor(n / 2)
    after = lambda n: F.floor(n / 2)
    return F.struct(
        F.greatest(F.lit(0), box["x1"] - before(k["w"])).cast("int").alias("x1"),
        F.greatest(F.lit(0), box["y1"] - before(k["h"])).cast("int").alias("y1"),
        F.least(width - 1, box["x2"] + after(k["w"])).cast("int").alias("x2"),
        F.least(height - 1, box["y2"] + after(k["h"])).cast("int").alias("y2"),
    )


def coordinates(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Opposite corners, as documents hold them."""
    return F.array(F.array(x, y), F.array(x + w, y + h))


def merge_touching(boxes: DataFrame, most: int = PAGE_BOXES) -> DataFrame:
    """Regions of boxes (page long, pos int, x1, y1, x2, y2 inclusive) that overlap or touch, diagonally too.

    Rows (page, x, y, w, h, members). Every row is a box, also where
    pos repeats. Boxes with nulls or without area are left out. Pages of up to ``most`` boxes are merged where their rows are, many in
    a batch; boxes of larger ones by ``merge_large``, which gives the same regions and needs no page in one task.
    """
    b = boxes.filter("x1 <= x2 and y1 <= y2 and page is not null")
    sizes = materialize(b.groupBy("page").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    if sizes.isEmpty():
        return _merge_small(b)
    large = b.join(sizes, "page", "left_semi")
    return _merge_small(b.join(sizes, "page", "left_anti")).unionByName(merge_large(large))


def _merge_small(b: DataFrame) -> DataFrame:
    """Pages whose boxes are compared in their batch: rows come page by page, and a page that a batch cuts waits for the next one."""
    schema = T.StructType([T.StructField("page", b.schema["page"].dataType), *[T.StructField(n, T.IntegerType()) for n in "xywh"], T.StructField("members", T.LongType())])

    def merge(t: pa.Table) -> pa.RecordBatch:
        page = t.column("page").to_numpy()
        x1, y1, x2, y2 = (t.column(c).to_numpy().astype(np.int64) for c in ("x1", "y1", "x2", "y2"))
        n = len(page)
        ends = np.repeat(np.append(np.flatnonzero(page[1:] != page[:-1]) + 1, n), np.diff(np.concatenate([[0], np.flatnonzero(page[1:] != page[:-1]) + 1, [n]])))
        later = ends - np.arange(n) - 1
        first = np.repeat(np.arange(n), later)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
        touch = (x1[first] <= x2[second] + 1) & (x1[second] <= x2[first] + 1) & (y1[first] <= y2[second] + 1) & (y1[second] <= y2[first] + 1)
        first, second = first[touch], second[touch]
        root = np.arange(n)
        while True:
            least = np.minimum(root[first], root[second])
            new = root.copy()
            np.minimum.at(new, first, least)
            np.minimum.at(new, second, least)
            np.minimum.at(new, root, new[:])
            new = new[new]
            if (new == root).all():
                break
            root = new
        order = np.argsort(root, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1]]))
        low_x, low_y = (np.minimum.reduceat(v[order], at) for v in (x1, y1))
        high_x, high_y = (np.maximum.reduceat(v[order], at) for v in (x2, y2))
        ints = [pa.array(v, pa.int32()) for v in (low_x, low_y, high_x - low_x + 1, high_y - low_y + 1)]
        members = np.diff(np.append(at, n))
        return pa.RecordBatch.from_arrays([t.column("page").combine_chunks().take(pa.array(order[at])), *ints, pa.array(members)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            page = t.column("page").to_numpy()
            cut = int(np.flatnonzero(page != page[-1])[-1]) + 1 if page[0] != page[-1] else 0
            held = t.slice(cut)
            if cut:
                yield merge(t.slice(0, cut))
        if held is not None and held.num_rows:
            yield merge(held)

    return b.select("page", "x1", "y1", "x2", "y2").repartition("page").sortWithinPartitions("page").mapInArrow(run, schema)


def merge_large(boxes: DataFrame) -> DataFrame:
    """``merge_touching`` for pages of any size.

    No pairs are formed: every box is laid out as runs of pixels by row; in a row, runs that meet
    form an island, found by a running maximum; a box links with the first box of each of its islands. Boxes that touch do so in a line in which one of them
    starts, so other lines aren't laid out. A page of very many boxes costs no more rows than its boxes have lines.
    """
    # boxes are told apart by a number that is written with them, so that it stays
    b = materialize(boxes.filter("x1 <= x2 and y1 <= y2").select("page", F.monotonically_increasing_id().alias("id"), "x1", "y1", "x2", "y2"))
    starts = b.groupBy("page").agg(F.collect_set("y1").alias("starts"))
    own = F.filter("starts", lambda y: (y >= F.col("y1")) & (y <= F.col("y2") + 1))
    rows = b.join(starts, "page").select("page", "id", "x1", "x2", F.explode(own).alias("line"))
    line = Window.partitionBy("page", "line").orderBy("x1", "id")
    reach = F.max("x2").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", (reach.isNull() | (F.col("x1") > reach + 1)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(line))
    first = F.first("id").over(Window.partitionBy("page", "line", "island").orderBy("x1", "id"))
    edges = islands.select(F.col("id").alias("a"), first.alias("b")).distinct()
    roots = components(edges)
    member = b.join(roots, b["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    merged = member.groupBy("page", "root").agg(
        F.min("x1").alias("x"), F.min("y1").alias("y"), F.max("x2").alias("_x2"), F.max("y2").alias("_y2"), F.count("*").alias("members")
    )
    return merged.select("page", "x", "y", (F.col("_x2") - F.col("x") + 1).alias("w"), (F.col("_y2") - F.col("y") + 1).alias("h"), "members")


def reading_order(regions: DataFrame, japanese: Column, name: str = "pos") -> DataFrame:
    """``regions`` (page, x, y, w, h, more) with their 0-based place on the page: by bands of 50 pixels, then across, from the right in Japanese.

    Equal places are ordered by y, h and w.
    """
    across = F.when(japanese, -F.col("x")).otherwise(F.col("x"))
    order = Window.partitionBy("page").orderBy(F.floor(F.col("y") / BAND), across, "y", "h", "w")
    return regions.withColumn(name, F.row_number().over(order) - 1)
