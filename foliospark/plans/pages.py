"""The page driver: each page through its providers, with retries on a smaller image, and titles put together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import natural_key

RESULT = "title string, page int, boxes array<struct<x:int,y:int,w:int,h:int>>, content binary, attempts int, error string"


def is_memory_error(e: Exception) -> bool:
    message = str(e).lower()
    return isinstance(e, MemoryError) or "cuda" in message or "out of memory" in message


def smaller(image: np.ndarray, factor: float = 0.75) -> np.ndarray:
    """The image at three quarters of its sides, one pixel at least, by nearest pixels."""
    return sized(image, *(max(1, int(n * factor)) for n in image.shape[:2]))


def on_canvas(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at the top left of a black one of the given size; what is outside is cut off."""
    out = np.zeros((height, width, *image.shape[2:]), dtype=image.dtype)
    part = image[:height, :width]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def sized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """The image with h rows and w columns, by nearest pixels."""
    rows, cols = np.arange(h) * image.shape[0] // h, np.arange(w) * image.shape[1] // w
    return image[rows][:, cols]


def process_pages(
    pages: DataFrame,
    detect: Callable[[np.ndarray], list[tuple[int, int, int, int]]],
    inpaint: Callable[[np.ndarray, list[tuple[int, int, int, int]]], np.ndarray],
    encode: Callable[[np.ndarray], bytes],
    attempts: int = 3,
) -> DataFrame:
    """Pages (title, page, image as Spark's image source has it) as rows RESULT.

    After a memory error a page is tried again at three quarters of its size, ``attempts`` times in all, and what comes of it is brought back to the
    page's own size, boxes too; a result larger or smaller than its input is put on a canvas of that first. Another error, or the last, is
    kept in ``error`` and the page stays without content. A page that couldn't be decoded is an error too. Pages are independent and one is in memory at a time.
    """

    def one(image: np.ndarray) -> tuple:
        height, width = image.shape[:2]
        for n in range(1, attempts + 1):
            try:
                boxes = detect(image)
                clean = on_canvas(inpaint(image, boxes), *image.shape[:2])
                if n > 1:
                    up, across = height / image.shape[0], width / image.shape[1]
                    clean = sized(clean, height, width)
                    boxes = [(int(x * across), int(y * up), max(1, int(w * across)), max(1, int(h * up))) for x, y, w, h in boxes]
                return [{"x": x, "y": y, "w": w, "h": h} for x, y, w, h in boxes], encode(clean), n, None
            except Exception as e:  # noqa: BLE001 whatever a provider raises belongs to its page
                if not is_memory_error(e) or n == attempts:
                    return None, None, n, f"{type(e).__name__}: {e}"
                image = smaller(image)
        raise AssertionError

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                if row.height is None or row.height <= 0 or row.data is None:
                    got = (None, None, 0, "the image can't be decoded")
                else:
                    got = one(np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels))
                yield pd.DataFrame([(row.title, row.page, *got)], columns=["title", "page", "boxes", "content", "attempts", "error"])

    flat = pages.select("title", "page", F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, RESULT)


def compile_titles(files: DataFrame, expected: DataFrame, suffix: str = "_Traducido.pdf") -> DataFrame:
    """Complete titles only: rows (title, name, files) of the results (title, file) in natural order, where there are as many as ``expected`` (title, n) says."""
    listed = files.groupBy("title").agg(F.array_sort(F.collect_set(F.struct(natural_key(F.col("file")).alias("k"), "file"))).alias("f"))
    return listed.join(expected, "title").filter(F.size("f") == F.col("n")).select("title", F.concat("title", F.lit(suffix)).alias("name"), F.transform("f", lambda x: x["file"]).alias("files"))
