"""Nearest place on the sphere, and the localisation of places and their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feature codes of cities (fixed values).
CITY_CODES = ("PPLC", "PPLA", "PPLA2", "PPLA3", "PPLA4")
#: A dimension up to this many rows goes to every task; a larger one is joined by grid cells.
BROADCAST_ROWS = 200_000


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], 1)


def nearest(points: DataFrame, places: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "geonameid") -> DataFrame:
    """Distinct (lat, lon) of ``points`` with the id of the nearest place (``geonameid, lat, lon``), ties to the smaller id.

    Points are made distinct first. The places' number is checked before they are sent to the tasks.
    """
    distinct = points.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    if places.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return _by_cells(distinct, places, out)
    rows = places.select("geonameid", "lat", "lon").orderBy("geonameid").toArrow()  # at most BROADCAST_ROWS
    if not rows.num_rows:
        return distinct.withColumn(out, F.lit(None).cast("long"))
    ids, lats, lons = (rows.column(k).to_numpy() for k in range(3))
    sent = points.sparkSession.sparkContext.broadcast((ids, _unit(lats, lons)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xyz = sent.value
        for b in batches:
            p = _unit(b.column(0).to_numpy(), b.column(1).to_numpy())
            step = max(1, 4_000_000 // len(ids))
            best = [(p[k : k + step] @ xyz.T).argmax(1) for k in range(0, len(p), step)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids[np.concatenate(best)] if best else np.zeros(0, np.int64))], ["lat", "lon", out])

    return distinct.mapInArrow(run, f"lat double, lon double, {out} long")


def _by_cells(points: DataFrame, places: DataFrame, out: str, degrees: float = 1.0) -> DataFrame:
    """Grid join: a point looks at the nine cells about it; where they hold nothing sure, at those of a grid four times as coarse.

    A hit is sure if it is nearer than the edge of the nine cells. The coarsest grid has one cell.
    """
    from tidemark.functions.geometry import haversine_km
    from tidemark.sources.tables import stage

    left, found = points, None
    while not left.isEmpty():
        whole = degrees >= 360
        around = int(-(-360 // degrees))
        cell = lambda c, low: F.floor((F.col(c) + low) / degrees).cast("int")  # noqa: E731, B023
        grid = places.select("geonameid", F.col("lat").alias("plat"), F.col("lon").alias("plon"), cell("lat", 90).alias("cy"), F.pmod(cell("lon", 180), F.lit(around)).alias("cx"))
        about = lambda c, low: F.explode(F.sequence(cell(c, low) - 1, cell(c, low) + 1))  # noqa: E731, B023
        ring = left.select("lat", "lon", about("lat", 90).alias("cy")).select("lat", "lon", "cy", about("lon", 180).alias("x"))
        ring = ring.select("lat", "lon", "cy", F.pmod(F.col("x"), F.lit(around)).alias("cx")).distinct()
        d = haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
        best = ring.join(grid, ["cy", "cx"]).withColumn("d", d).groupBy("lat", "lon").agg(F.min(F.struct("d", "geonameid")).alias("b"))
        narrow = F.greatest(F.lit(0.0), F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("lat")) + degrees))))
        sure = F.col("b.d") <= degrees * 111.0 * narrow
        done = stage(best.where(sure | F.lit(whole)).select("lat", "lon", F.col("b.geonameid").alias(out)), "nearest")
        found = done if found is None else found.union(done)
        if whole:
            break
        left = stage(left.join(done, ["lat", "lon"], "left_anti"), "nearest-left")
        degrees *= 4
    return found if found is not None else points.withColumn(out, F.lit(None).cast("long"))


def resolve(points: DataFrame, places: DataFrame) -> DataFrame:
    """(lat, lon, country, city_geonameid, district_geonameid): country of the nearest place, nearest city, and the
    nearest place as district unless it is that city."""
    any_place = nearest(points, places, out="near_id")
    city = nearest(points, places.where(F.col("fcode").isin(*CITY_CODES)), out="city_geonameid")
    cc = places.select(F.col("geonameid").alias("near_id"), F.col("cc").alias("country"))
    both = any_place.join(city, ["lat", "lon"]).join(cc, "near_id", "left")
    district = F.when(~F.col("near_id").eqNullSafe(F.col("city_geonameid")), F.col("near_id"))
    return both.select("lat", "lon", "country", "city_geonameid", district.alias("district_geonameid"))


def localized(ids: DataFrame, id_col: str, dims: dict[str, DataFrame], lang: str = "en", out: str = "name") -> DataFrame:
    """``ids`` plus ``out``: name in ``lang``, else English, else the dimension's own, else the id; and ``<out>_exact``."""
    names = dims["names"]
    own = names.where(F.col("lang") == lang).select(F.col("geonameid").alias(id_col), F.col("name").alias("_own"))
    en = names.where(F.col("lang") == "en").select(F.col("geonameid").alias(id_col), F.col("name").alias("_en"))
    base = dims["places"].select(F.col("geonameid").alias(id_col), F.col("name_en").alias("_base"))
    other = dims["admin1"].select("geonameid", "name_en").union(dims["countries"].select("geonameid", "name_en")).groupBy(F.col("geonameid").alias(id_col)).agg(F.min("name_en").alias("_other"))
    d = ids
    for t in (own, en, base, other):
        d = d.join(t, id_col, "left")
    chain = F.coalesce("_own", "_en", F.nullif("_base", F.lit("")), F.nullif("_other", F.lit("")), F.col(id_col).cast("string"))
    return d.withColumn(out, chain).withColumn(f"{out}_exact", F.col("_own").isNotNull()).drop("_own", "_en", "_base", "_other")


def region_key(cc: Column, admin1: Column) -> Column:
    """``cc.admin1``; null if either is missing."""
    return F.when((F.coalesce(cc, F.lit("")) != "") & (F.coalesce(admin1, F.lit("")) != ""), F.concat_ws(".", cc, admin1))


def _proper(names: DataFrame, id_col: str, name: str) -> DataFrame:
    """Names that are no bare ids."""
    return names.withColumn(name, F.when(F.col(name) != F.col(id_col).cast("string"), F.col(name)))


def about_cities(ids: DataFrame, dims: dict[str, DataFrame], lang: str = "en", id_col: str = "city_geonameid") -> DataFrame:
    """``ids`` plus lat, lon, region (its key), region_name, country_name of each place; null where the tables lack them.

    ``dims``: places, names, admin1, countries. Names of regions and countries are never bare ids.
    """
    place = dims["places"].select(F.col("geonameid").alias(id_col), "lat", "lon", "cc", "admin1")
    region = localized(dims["admin1"].select(F.col("geonameid").alias("_g"), "cc", "admin1"), "_g", dims, lang, "region_name")
    land = localized(dims["countries"].select(F.col("geonameid").alias("_g"), "cc"), "_g", dims, lang, "country_name")
    d = ids.join(place, id_col, "left").withColumn("region", region_key(F.col("cc"), F.col("admin1")))
    d = d.join(_proper(region, "_g", "region_name").select("cc", "admin1", "region_name"), ["cc", "admin1"], "left")
    return d.join(_proper(land, "_g", "country_name").select("cc", "country_name"), "cc", "left").drop("cc", "admin1")


def country_codes(dims: dict[str, DataFrame], lang: str = "en") -> DataFrame:
    """(folded, cc): countries by their names in ``lang``, without regard to case."""
    from tidemark.functions.text import casefold

    land = localized(dims["countries"].select(F.col("geonameid").alias("_g"), "cc"), "_g", dims, lang, "name")
    return _proper(land, "_g", "name").where("name IS NOT NULL").select(casefold(F.col("name")).alias("folded"), "cc")


def city_names(dims: dict[str, DataFrame], lang: str = "en") -> DataFrame:
    """(folded, geonameid): cities, of each feature code that counts as one, by their names in ``lang``; homonyms are rows of their own."""
    from tidemark.functions.text import casefold

    cities = dims["places"].where(F.col("fcode").isin(*CITY_CODES)).select(F.col("geonameid").alias("_g"))
    return localized(cities, "_g", dims, lang, "name").select(casefold(F.col("name")).alias("folded"), F.col("_g").alias("geonameid"))
