"""Events: sessions of dated files, merged into trips, named, with manual ones kept."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_bound, span_name
from tidemark.functions.geometry import haversine_km
from tidemark.operators import sessions, trips
from tidemark.operators.grouping import carry_over, dominant
from tidemark.schema import canonical
from tidemark.sources.tables import stage


def in_ranges(df: DataFrame, ts: str, ranges: DataFrame) -> DataFrame:
    """Rows with the ranges (range_id, lo, hi) they fall into, both ends included: an equi-join on the days of a range."""
    day = ranges.where("lo <= hi").withColumn("_d", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))))
    return df.withColumn("_d", F.to_date(ts)).join(day, "_d").where(F.col(ts).between(F.col("lo"), F.col("hi"))).drop("_d")


def overlapping(ranges: DataFrame) -> DataFrame:
    """(a, b): ranges that overlap: each start is looked for among ranges that began before and have not ended."""
    w = Window.orderBy("lo", "range_id").rowsBetween(Window.unboundedPreceding, -1)
    hit = ranges.withColumn("_m", F.max(F.struct("hi", "range_id")).over(w)).where(F.col("_m.hi") >= F.col("lo"))
    return hit.select(F.col("_m.range_id").alias("a"), F.col("range_id").alias("b"))


def with_locality(files: DataFrame, places: DataFrame) -> DataFrame:
    """``locality``: the city's id, else its text without regard to case; ``country``; coordinates and region where known."""
    from tidemark.functions.text import casefold

    p = places.withColumnRenamed("file_id", "id")
    name = F.coalesce(F.col("district_name") if "district_name" in p.columns else F.lit(None).cast("string"), F.col("city") if "city" in p.columns else F.lit(None).cast("string"))
    given = F.coalesce(name, F.lit("")) != ""
    key = F.when(F.col("city_geonameid").isNotNull(), F.concat(F.lit("i:"), F.col("city_geonameid").cast("string"))).when(given, F.concat(F.lit("s:"), casefold(F.trim(name))))
    return files.join(p, "id", "left").withColumn("locality", key)


def same_trip(max_km: float):
    """One country, and one locality, one region or cities within ``max_km``. Anchors: country, locality, region, lat, lon."""

    def same(a, b):
        near = (haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]) <= max_km) if max_km > 0 else F.lit(False)
        return (a["country"] == b["country"]) & (
            F.coalesce(a["locality"] == b["locality"], F.lit(False)) | F.coalesce(a["region"] == b["region"], F.lit(False)) | F.coalesce(near, F.lit(False))
        )

    return same


def place_names(members: DataFrame) -> DataFrame:
    """(trip, place): one locality gives its name; of several the region of the most frequent one, else its country,
    else its own name; without any locality, null. ``members``: trip, locality, place_name, region_name, country_name, taken_at, id."""
    most = dominant(members, ["trip"], "locality", ["taken_at", "id"], "locality").select("trip", "locality", "n_values")
    first = members.join(most, ["trip", "locality"]).groupBy("trip", "n_values").agg(F.min_by(F.struct("place_name", "region_name", "country_name"), F.struct("taken_at", "id")).alias("x"))
    known = lambda c: F.nullif(F.col(f"x.{c}"), F.lit(""))
    wide = F.coalesce(known("region_name"), known("country_name"), F.col("x.place_name"))
    return first.select("trip", F.when(F.col("n_values") == 1, F.col("x.place_name")).otherwise(wide).alias("place"))


def build(files: DataFrame, gap_hours: float = 6, trip_gap_hours: float = 48, least: int = 5, max_km: float = 120, manual_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, event_files) from canonical files with locality columns (id, taken_at, taken_at_confidence, country,
    locality, region, lat, lon, place_name; region_name and country_name where known)."""
    d = canonical(files).where(F.col("taken_at").isNotNull() & ~F.col("taken_at_confidence").eqNullSafe("low"))
    if manual_files is not None:
        d = d.join(manual_files.select(F.col("file_id").alias("id")), "id", "left_anti")
    for c in ("region_name", "country_name"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    d = sessions.overall(d, "taken_at", ["id"], gap_hours * 3600)
    # Files farther apart than the trip gap can share no trip: each run between such gaps is merged by itself.
    d = stage(sessions.overall(d, "taken_at", ["id"], max(gap_hours, trip_gap_hours) * 3600, "run"), "event-files")
    dom = dominant(d, ["session"], "locality", ["taken_at", "id"], "locality").select("session", "locality")
    country = dominant(d, ["session"], "country", ["taken_at", "id"], "country").select("session", "country")
    where = d.select("session", "locality", "region", "lat", "lon", "taken_at", "id")
    about = where.join(dom, ["session", "locality"]).groupBy("session").agg(F.min_by(F.struct("locality", "region", "lat", "lon"), F.struct("taken_at", "id")).alias("x"))
    s = sessions.summary(d, ["session", "run"], "taken_at").join(about, "session", "left").join(country, "session", "left").select("session", "run", "started_at", "ended_at", "n", "country", "x.*")
    t = trips.merge(s, ["run"], trip_gap_hours * 3600, ["country", "locality", "region", "lat", "lon"], same_trip(max_km))
    line = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row per run
    starts = t.groupBy("run").agg(F.max("trip").alias("n")).select("run", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("base"))
    t = t.join(starts, "run").withColumn("trip", F.col("trip") + F.col("base"))
    members = d.join(t.select("session", "trip"), "session")
    place = place_names(members)
    events = sessions.summary(members, ["trip"], "taken_at", least).join(place, "trip", "left")
    events = events.select(F.col("trip").cast("long").alias("id"), "started_at", "ended_at", F.col("place").alias("place_city"), span_name(F.col("started_at"), F.col("ended_at"), F.col("place")).alias("name"), F.lit(False).alias("name_is_manual"), F.lit("auto").alias("origin"))
    return events, members.join(events.select(F.col("id").alias("trip")), "trip", "left_semi").select(F.col("trip").cast("long").alias("event_id"), F.col("id").alias("file_id"))


def keep_manual_names(new: DataFrame, new_files: DataFrame, old: DataFrame, old_files: DataFrame) -> DataFrame:
    """New events take over the manual name of an old event of which they hold more than half the files."""
    named = old.where("name_is_manual").select(F.col("id").alias("old_group"), F.col("name").alias("_name"))
    o = old_files.select(F.col("event_id").alias("old_group"), "file_id").join(named.select("old_group"), "old_group", "left_semi")
    c = carry_over(o, new_files.select(F.col("event_id").alias("new_group"), "file_id"), "file_id", "old").join(named, "old_group")
    d = new.join(c.select(F.col("new_group").alias("id"), "_name"), "id", "left")
    return d.withColumn("name_is_manual", F.col("_name").isNotNull() | F.col("name_is_manual")).withColumn("name", F.coalesce("_name", "name")).drop("_name")


def rename(events: DataFrame, event_id: int, name: str) -> DataFrame:
    if events.where(F.col("id") == event_id).isEmpty():
        raise ValueError(f"no event {event_id}")
    hit = F.col("id") == event_id
    return events.withColumn("name", F.when(hit, F.lit(name)).otherwise(F.col("name"))).withColumn("name_is_manual", hit | F.col("name_is_manual"))


def add_manual(events: DataFrame, event_files: DataFrame, files: DataFrame, name: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """A manual event over [start, end]: takes its files from automatic events, which go when they are empty."""
    lo, hi = parse_bound(start), parse_bound(end, True)
    if not name.strip() or hi < lo:
        raise ValueError("an event needs a name and an end after its start")
    manual = events.where("origin = 'manual'")
    if not manual.where((F.lit(lo) <= F.col("ended_at")) & (F.lit(hi) >= F.col("started_at"))).isEmpty():
        raise ValueError("it overlaps another manual event")
    spark = events.sparkSession
    new_id = (events.agg(F.max("id")).first()[0] or 0) + 1
    own = canonical(files).where(F.col("taken_at").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))).select(F.lit(new_id).cast("long").alias("event_id"), F.col("id").alias("file_id"))
    manual_ids = manual.select(F.col("id").alias("event_id"))
    kept = event_files.join(manual_ids, "event_id", "left_semi").unionByName(event_files.join(manual_ids, "event_id", "left_anti").join(own.select("file_id"), "file_id", "left_anti").select("event_id", "file_id"))
    now = kept.unionByName(own)
    row = spark.createDataFrame([(new_id, lo, hi, None, name.strip(), True, "manual")], "id long, started_at timestamp_ntz, ended_at timestamp_ntz, place_city string, name string, name_is_manual boolean, origin string")
    left = events.join(now.select(F.col("event_id").alias("id")).distinct(), "id", "left_semi").unionByName(manual).distinct()
    return left.unionByName(row), now


def bounds(start: str, end: str) -> tuple[datetime, datetime]:
    return parse_bound(start), parse_bound(end, True)
