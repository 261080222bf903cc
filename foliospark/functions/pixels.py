"""Statistics of pixels, as Columns over arrays and as numpy functions over images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(values: Column) -> Column:
    """The mean of an array of whole numbers; null if it is empty."""
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def page_format(gray_mean: Column) -> Column:
    """Very dark or very light pages count as black and white; 50 and 200 are colour."""
    return F.when((gray_mean < 50) | (gray_mean > 200), F.lit("Blanco y negro (B/N)")).otherwise(F.lit("Color"))


def fill_color(region_mean: Column) -> Column:
    return F.when(region_mean > 128, F.lit("white")).otherwise(F.lit("black"))


def text_colors(around_mean: Column) -> Column:
    """Outline and fill of text by what it lies on."""
    dark = around_mean < 128
    return F.struct(F.when(dark, F.lit("black")).otherwise(F.lit("white")).alias("outline"), F.when(dark, F.lit("white")).otherwise(F.lit("black")).alias("fill"))


def composite(out: Column, original: Column, mask: Column) -> Column:
    """``out`` where the mask is 1, ``original`` where it is 0."""
    pairs = F.zip_with(out, original, lambda o, g: F.struct(o.alias("o"), g.alias("g")))
    return F.zip_with(pairs, mask, lambda p, m: p["o"] * m + p["g"] * (1 - m))


def gray(image: np.ndarray) -> np.ndarray:
    """Brightness of pixels in blue, green, red order, or of gray ones as they are; an alpha channel is ignored."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2]).astype(np.uint8)
    b, g, r = (image[..., i].astype(np.float64) for i in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)


def otsu(values: np.ndarray) -> int:
    """The threshold that parts bright from dark best: pixels above it are bright. 0 for an empty or flat image."""
    return otsu_of(np.bincount(values.ravel(), minlength=256))


def otsu_of(counts: np.ndarray) -> int:
    """``otsu`` from how many pixels have each of the 256 values."""
    n = counts.astype(np.float64)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((below > 0) & (above > 0), (below[-1] * mass - below * mass[-1]) ** 2 / (below * above), 0)
    return int(np.argmax(between))


def binarize(image: np.ndarray) -> np.ndarray:
    """Black text on white, in three channels, from a part of a page."""
    g = gray(image)
    white = g > otsu(g)
    if 2 * int(white.sum()) < white.size:
        white = ~white
    return np.repeat(np.where(white, 255, 0).astype(np.uint8)[..., None], 3, axis=2)


def fill_boxes(image: np.ndarray, boxes: list[tuple[int, int, int, int]], grow: int = 1) -> np.ndarray:
    """Detections (x, y, inclusive w, h) painted white or black by the original's mean around them."""
    out, (height, width) = image.copy(), image.shape[:2]
    for x, y, w, h in boxes:
        left, top = max(0, x - grow), max(0, y - grow)
        wide, high = min(w + grow, width - left), min(h + grow, height - top)
        part = image[top : top + high, left : left + wide]
        if part.size:
            out[top : min(height, top + high + 1), left : min(width, left + wide + 1)] = 255 if part.mean() > 128 else 0
    return out


def model_input(image: np.ndarray, mask: np.ndarray, least: int = 128, signed: bool = True) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """What an inpainting model gets: channels first, scaled to -1..1 (or 0..1), zero in the hole; the mask as 0 and 1; rows and columns added.

    Smaller sides are filled up to ``least`` by reflection.
    """
    add = [(0, max(0, least - n)) for n in image.shape[:2]]
    image, mask = np.pad(image, [*add, (0, 0)], mode="symmetric"), np.pad(mask, add, mode="symmetric")
    scaled = image.transpose(2, 0, 1).astype(np.float32) / (127.5 if signed else 255) - (1 if signed else 0)
    hole = (mask.astype(np.float32) / 255 >= 0.5).astype(np.float32)
    return scaled * (1 - hole), hole, (add[0][1], add[1][1])


def rings(mask: np.ndarray, most: int = 127, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """How far each hole pixel is from what is known, in steps to any of eight neighbours, and from which of four corners it is reached.

    The distance is scaled as the model expects and cut at ``most``. A mask without any known pixel gives zeros.
    """
    hole = mask > 0
    distance, directions = np.zeros(hole.shape, dtype=np.int32), np.zeros((*hole.shape, 4), dtype=np.int32)
    known = ~hole
    if not known.any():
        return distance, directions
    step = 0
    shifts = [((0, 0), (-1, 0), (0, -1), (-1, -1)), ((0, 0), (1, 0), (0, -1), (1, -1)), ((0, 0), (-1, 0), (0, 1), (-1, 1)), ((0, 0), (1, 0), (0, 1), (1, 1))]
    while not known.all():
        step += 1
        padded = np.pad(known, 1, mode="reflect" if min(known.shape) > 1 else "edge")
        look = lambda dy, dx: padded[1 + dy : 1 + dy + known.shape[0], 1 + dx : 1 + dx + known.shape[1]]
        grown = np.zeros_like(known)
        for k, group in enumerate(shifts):
            reached = np.zeros_like(known)
            for dy, dx in group:
                reached |= look(dy, dx)
            directions[..., k] |= reached & ~known
            grown |= reached
        distance[grown & ~known] = step
        known = grown
    scaled = np.clip((distance / (size / 2) * (most + 1)).astype(np.int32), 0, most)
    return scaled, directions
