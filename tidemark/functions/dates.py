"""Capture times from camera fields, file names and modification times."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, time

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name patterns, the narrowest first (fixed values): pattern, has a time of day.
FILENAME_PATTERNS = (
    (r"(?<!\d)(\d{4})(\d{2})(\d{2})[-_](\d{2})(\d{2})(\d{2})(?:\d{3})?(?!\d)", True),
    (r"(?<!\d)(\d{4})-(\d{2})-(\d{2})[ _](?:at[ _])?(\d{2})[.\-:](\d{2})[.\-:](\d{2})(?!\d)", True),
    (r"(?i)(?<!\d)(\d{4})(\d{2})(\d{2})-WA\d+", False),
    (r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)", False),
    (r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", False),
)
EXIF_FORMATS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bounded(ts: Column, lo: int, hi: int) -> Column:
    return _once(ts, lambda t: F.when(F.year(t).between(lo, hi), t))


def from_exif(value: Column, lo: int = 1990, hi: int = 2035) -> Column:
    """The first format that fits the first 19 characters and whose year is in bounds."""
    text = F.substring(value, 1, 19)
    return F.coalesce(*[_bounded(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz"), lo, hi) for f in EXIF_FORMATS])


def from_filename(name: Column, lo: int = 1990, hi: int = 2035) -> Column:
    """The first pattern whose first match is a date in bounds.

    A pattern is matched once: its groups are the first digits of the match, in order.
    """

    def attempt(pattern: str, timed: bool) -> Column:
        digits = F.regexp_replace(F.regexp_extract(name, pattern, 0), r"\D", "")
        known = F.substring(digits, 1, 14 if timed else 8)
        return _bounded(F.try_to_timestamp(known, F.lit("yyyyMMddHHmmss" if timed else "yyyyMMdd")).cast("timestamp_ntz"), lo, hi)

    return F.when(name.rlike(r"\d{4}"), F.coalesce(*[attempt(p, t) for p, t in FILENAME_PATTERNS]))


def cascade(exif: Column, name: Column, mtime: Column, zone: str = "UTC", lo: int = 1990, hi: int = 2035) -> Column:
    """struct(taken_at, source, confidence): camera, else file name, else modification time in ``zone``."""

    def found(ts: Column, source: str, confidence: str) -> Column:
        return _once(ts, lambda t: F.when(t.isNotNull(), F.struct(t.alias("taken_at"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))))

    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_seconds(mtime).cast("timestamp_ntz"))
    return F.coalesce(found(from_exif(exif, lo, hi), "exif", "high"), found(from_filename(name, lo, hi), "filename", "medium"), found(local, "mtime", "low"))


def year_of(taken_at: Column, confidence: Column) -> Column:
    """The year as text; null without date or if the date is a guess."""
    return F.when(taken_at.isNotNull() & ~confidence.eqNullSafe("low"), F.date_format(taken_at, "yyyy"))


def parse_bound(text: str, end: bool = False) -> datetime:
    """ISO date or time; a date alone as end means its last microsecond."""
    text = text.strip()
    if len(text) <= 10:
        return datetime.combine(date.fromisoformat(text), time.max if end else time.min)
    return datetime.fromisoformat(text).replace(tzinfo=None)


def span_name(start: Column, end: Column, place: Column | None = None) -> Column:
    """``Y-m-d``, ``Y-m-d..m-d`` within a year, else ``Y-m-d..Y-m-d``, then the place if known."""
    full = lambda c: F.date_format(c, "yyyy-MM-dd")
    base = F.when(F.to_date(start) == F.to_date(end), full(start)).when(F.year(start) == F.year(end), F.concat(full(start), F.lit(".."), F.date_format(end, "MM-dd"))).otherwise(
        F.concat(full(start), F.lit(".."), full(end))
    )
    return base if place is None else F.when(F.coalesce(place, F.lit("")) != "", F.concat_ws(" ", base, place)).otherwise(base)
