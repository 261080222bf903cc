"""File names: natural order, extensions, the names of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = ("jpg", "png", "jpeg", "bmp", "webp")
WIDE, NARROW = "０１２３４５６７８９", "0123456789"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(name: Column) -> Column:
    """The last dot and what follows it; empty if only dots come before."""
    return F.regexp_extract(name, r"(?s)^(.*[^.].*)(\.[^.]*)$", 2)


def stem(name: Column) -> Column:
    """The name without its extension."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def is_image(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(EXTENSIONS) + r")$")


def natural_key(name: Column) -> Column:
    """An array that sorts as people count: digit runs as numbers, the rest lower-cased.

    Full-width digits count as digits; other digit-like characters are text. Numbers of up to 38 digits compare as numbers.
    """
    plain = F.lower(F.translate(name, WIDE, NARROW))
    texts = F.split(plain, r"[0-9]+", -1)
    numbers = F.regexp_extract_all(plain, F.lit(r"([0-9]+)"))
    return F.transform(
        texts, lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get(numbers, i).cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")).alias("d"))
    )


def result_name(name: Column) -> Column:
    """The name of a page's result: the first digit run, of four digits at least, and the extension; WebP becomes JPEG.

    Without digits the stem stays.
    """
    ext = extension(name)
    base = stem(name)
    digits = F.regexp_extract(F.translate(base, WIDE, NARROW), "([0-9]+)", 1)
    significant = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    number = F.when(F.length(significant) >= 4, significant).otherwise(F.lpad(significant, 4, "0"))
    return F.concat(F.when(digits == "", base).otherwise(number), F.when(F.lower(ext) == ".webp", F.lit(".jpg")).otherwise(ext))
