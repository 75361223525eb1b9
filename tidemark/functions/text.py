"""Names, paths and their cleaning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names that a common file system reserves, and signs it forbids (fixed values).
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1F]'
#: Release names of films and series (fixed patterns).
RELEASE = (
    r"(?i)\bS\d{1,2}E\d{1,3}\b|\b\d{1,2}x\d{2}\b",
    r"(?i)\b(720p|1080p|2160p|4k)\b",
    r"(?i)\b(webrip|web-?dl|bluray|bdrip|hdtv|dvdrip)\b",
    r"(?i)\b(x264|x265|hevc|h\.?264|h\.?265)\b",
    r"\[[^\[\]]{2,30}\]",
    r"(?:[A-Za-z0-9]+\.){3,}(?:19|20)\d{2}\.",
)
#: Names and folders of screenshots (fixed values).
SCREENSHOT = r"(?iu)^(screen[ _-]?shot|снимок[ _]экрана)"
SCREENSHOT_FOLDERS = ["screenshots", "screenshot"]


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding, which no built-in function does."""
    return s.str.casefold()


def same_folded(a: Column, b: Column) -> Column:
    return casefold(a) == casefold(b)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def sanitize(name: Column) -> Column:
    """A folder name: forbidden signs become ``_``; never empty, reserved or ending in blank or dot."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, FORBIDDEN, "_"), r"^\s+|\s+$", ""), r"[ .]+$", "")
    return F.when(s == "", F.lit("_")).when(F.upper(F.substring_index(s, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), s)).otherwise(s)


def sanitize_generated(text: Column, most: int = 80) -> Column:
    """The first line of a generated name without quotes and forbidden signs; null if nothing is left."""
    line = F.regexp_replace(F.regexp_extract(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^[^\r\n]*", 0), r"^\s+|\s+$", "")
    line = F.regexp_replace(F.regexp_replace(line, "^[\"'«»]+|[\"'«»]+$", ""), r"\.+$", "")
    line = F.regexp_replace(F.regexp_replace(line, r'[\\/:*?"<>|]', " "), r"\s+", " ")
    line = F.substring(F.trim(line), 1, most)
    return F.when(line != "", line)


def is_release(name: Column) -> Column:
    out = F.lit(False)
    for p in RELEASE:
        out = out | F.rlike(name, F.lit(p))
    return out


def is_screenshot_name(name: Column) -> Column:
    return F.rlike(name, F.lit(SCREENSHOT))


def in_screenshot_folder(path: Column) -> Column:
    return F.exists(F.split(path, r"[\\/]"), lambda s: F.lower(s).isin(SCREENSHOT_FOLDERS))


def media_type(ext: Column, extensions: dict[str, list[str]]) -> Column:
    e = F.regexp_replace(F.lower(ext), r"^\.+", "")
    out = F.lit(None).cast("string")
    for kind, known in reversed(list(extensions.items())):
        out = F.when(e.isin(known), F.lit(kind)).otherwise(out)
    return out


def below(path: Column, folder: str) -> Column:
    """The folder itself or anything in it, at a path boundary and without wildcards."""
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/")


def relative_to(dst: Column, root: str) -> Column:
    """``dst`` relative to ``root`` if it lies below it, else as it is."""
    root = root.rstrip("/") + "/"
    return F.when(dst.startswith(root), F.substring(dst, len(root) + 1, 1 << 30)).otherwise(dst)


@F.pandas_udf(StringType())
def file_uri(path: pd.Series) -> pd.Series:
    """A percent-encoded file:// address; the built-in encoder writes form encoding."""
    from urllib.parse import quote

    return path.map(lambda p: None if p is None else "file://" + quote(p))


def tree_sort_keys(name: Column) -> list[Column]:
    """Numbers first and by value, then names without regard to case."""
    number = F.when(F.rlike(name, F.lit(r"^\d+$")), name.try_cast("decimal(38,0)"))
    return [number.asc_nulls_last(), F.lower(name).asc()]
