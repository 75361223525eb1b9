"""Distances on the sphere, areas in the plane, bits of signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def coordinate(value: Column) -> Column:
    """A number or null: blanks and garbage are no coordinate."""
    return value.cast("string").try_cast("double")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def unit_xyz(lat: Column, lon: Column) -> Column:
    a, o = F.radians(lat), F.radians(lon)
    return F.array(F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a))


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a closed polygon given as two arrays."""
    turn = lambda a: F.concat(F.slice(a, 2, 1 << 20), F.slice(a, 1, 1))
    terms = F.zip_with(F.zip_with(xs, turn(ys), lambda x, y: x * y), F.zip_with(turn(xs), ys, lambda x, y: x * y), lambda p, q: p - q)
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def bbox_area(box: Column) -> Column:
    """Area of ``[x1, y1, x2, y2]``; anything else has none."""
    at = lambda k: F.get(box, F.lit(k)).cast("double")
    return F.when(F.size(box) == 4, F.coalesce(F.abs((at(2) - at(0)) * (at(3) - at(1))), F.lit(0.0))).otherwise(0.0)


def text_fraction(boxes: Column, polygons: Column, width: Column, height: Column) -> Column:
    """Share of a picture under text: boxes [xmin, xmax, ymin, ymax], polygons of (x, y) pairs; overlaps count twice, at most 1."""
    side = lambda b, i, j: F.greatest(F.lit(0.0), F.get(b, F.lit(j)).cast("double") - F.get(b, F.lit(i)).cast("double"))
    flat = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + side(b, 0, 1) * side(b, 2, 3))
    area = lambda p: polygon_area(F.transform(p, lambda q: F.get(q, F.lit(0)).cast("double")), F.transform(p, lambda q: F.get(q, F.lit(1)).cast("double")))
    free = F.aggregate(polygons, F.lit(0.0), lambda s, p: s + F.when(F.size(p) >= 3, area(p)).otherwise(0.0))
    return F.when((width > 0) & (height > 0), F.least(F.lit(1.0), (flat + free) / (width * height)))


def bits(hexa: Column) -> Column:
    """The digits of a hexadecimal string as bits, four each."""
    four = lambda i: F.lpad(F.conv(F.substring(hexa, i, F.lit(1)), 16, 2), 4, "0")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(hexa)), four), "")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hexadecimal strings differ; null if their lengths do. Taken in pieces of 32 bits: a 64-bit cast would overflow."""
    piece = lambda c, i: F.conv(F.substring(c, i, F.lit(8)), 16, 10).try_cast("long")
    differ = lambda i: F.bit_count(piece(a, i).bitwiseXOR(piece(b, i)))
    starts = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(8))
    total = F.aggregate(starts, F.lit(0), lambda n, i: n + F.coalesce(differ(i), F.lit(0)))
    usual = differ(F.lit(1)) + differ(F.lit(9))  # 16 digits: no loop, so that it runs in generated code
    return F.when(F.length(a) != F.length(b), F.lit(None).cast("int")).when(F.length(a) == 16, usual).otherwise(total)
