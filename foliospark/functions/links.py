"""Links and headers of remote files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRIVE = r"^https?://drive\.google\.com/file/d/[^\n]+/view"
DROPBOX = r"^https?://(www\.)?dropbox\.com/scl/[^\n]"


def direct_link(url: Column) -> Column:
    """A shared file's page as the link of the file itself; other links stay."""
    found = F.regexp_extract(url, "d/([a-zA-Z0-9_-]+)", 1)
    drive = F.when(found != "", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), found)).otherwise(url)
    return F.when(url.rlike(DRIVE), drive).when(url.rlike(DROPBOX), F.replace(url, F.lit("?dl=0"), F.lit("?dl=1"))).otherwise(url)


def file_id(url: Column) -> Column:
    """The id after /d/, or null."""
    return F.nullif(F.regexp_extract(url, r"/d/([^/]+)", 1), F.lit(""))


def folder_id(url: Column) -> Column:
    """The ``id`` parameter, else the last part of the path, or null."""
    asked = F.nullif(F.regexp_extract(url, r"[?&]id=([^&#]*)", 1), F.lit(""))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.coalesce(asked, F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit("")))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda p: p != "")


def quoted_filename(header: Column) -> Column:
    """The quoted file name of a header, percent-decoded; a plus sign stays one. Null if there is none."""
    raw = F.nullif(F.regexp_extract(header, r'filename="(.+)"', 1), F.lit(""))
    return F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def plain_filename(header: Column, default: str) -> Column:
    """The file name, quoted or not and not decoded, else the default, always ending in .zip."""
    raw = F.coalesce(F.nullif(F.regexp_extract(header, r'filename="?([^"]+)"?', 1), F.lit("")), F.lit(default))
    return F.when(F.endswith(F.lower(raw), F.lit(".zip")), raw).otherwise(F.concat(raw, F.lit(".zip")))
