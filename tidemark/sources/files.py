"""Folders of media files, camera records and geographic tables as DataFrames."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Index
from tidemark.functions.text import media_type

SEEN = "path string, size long, mtime double, ext string"


def _listed(root: str, cfg: Index, deep: bool = True) -> Iterator[tuple[str, int, float, str]]:
    """Known files below a folder (or in it alone) in name order."""
    known = {e for v in cfg.extensions.values() for e in v}
    found = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if deep and not n.startswith(".") and n not in cfg.skip_dirs]
        found += [os.path.join(folder, f) for f in files if not f.startswith(".") and f not in cfg.skip_dirs]
    for path in sorted(found):
        ext = os.path.splitext(path)[1].lower().lstrip(".")
        try:
            st = os.stat(path)
        except OSError:
            continue
        if ext in known and os.path.isfile(path) and st.st_size >= cfg.min_file_size_kb * 1024:
            yield path, st.st_size, st.st_mtime, ext


def walk(roots: list[str], cfg: Index | None = None) -> Iterator[tuple[str, int, float, str]]:
    """Known files in name order: no hidden or skipped folder on the way, at least the least size. Spark's own listing
    would leave out names that begin with ``_``."""
    for root in roots:
        yield from _listed(root, cfg or Index())


def _folders(roots: list[str], cfg: Index, enough: int) -> list[tuple[str, bool]]:
    """Folders to list as a whole, and those above them to list without their folders: level by level until there are enough."""
    level, above = list(roots), []
    while level and len(level) < enough:
        below = []
        for folder in level:
            try:
                below += [e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and e.name not in cfg.skip_dirs]
            except OSError:
                continue
        above += level
        level = below
    return [(f, True) for f in level] + [(f, False) for f in above]


def scan(spark: SparkSession, roots: list[str], cfg: Index | None = None, partitions: int = 8) -> DataFrame:
    """All files that :func:`walk` finds. The driver looks at the upper folders only, until there is a folder for each task to walk."""
    cfg = cfg or Index()
    folders = spark.createDataFrame(_folders(roots, cfg, 8 * partitions), "folder string, deep boolean").repartition(partitions, "folder")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder, deep in zip(b["folder"], b["deep"], strict=True):
                yield pd.DataFrame(list(_listed(folder, cfg, deep)), columns=["path", "size", "mtime", "ext"])

    return folders.mapInPandas(run, SEEN).withColumn("media_type", media_type(F.col("ext"), cfg.extensions))


def content_hash(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            h.update(part)
    return h.hexdigest()


def with_hashes(files: DataFrame) -> DataFrame:
    """``hash``, ``hash_algo`` and ``error``, reading each file in pieces on the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes, errors = [], []
            for p in b["path"]:
                try:
                    hashes.append(content_hash(p))
                    errors.append(None)
                except OSError as e:
                    hashes.append(None)
                    errors.append(str(e))
            yield b.assign(hash=hashes, hash_algo="sha256", error=errors)

    schema = ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", hash string, hash_algo string, error string"
    return files.mapInPandas(run, schema)


def read_with(df: DataFrame, provider: Callable[[list[str]], list[dict[str, Any]]], schema: str, path: str = "path", size: int = 200) -> DataFrame:
    """One row per path from a provider of models or external readers, called on the tasks with lists of paths.

    A provider that fails on a list is tried path by path; a path it fails on gives nulls, and the reason in ``read_error``.
    """
    names = [p.strip().split(" ")[0] for p in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = b[path].tolist()
            for k in range(0, len(paths), size):
                part = paths[k : k + size]
                try:
                    rows = provider(part)
                except Exception:  # noqa: BLE001  any reader's error costs its file, not the job
                    rows = []
                    for p in part:
                        try:
                            rows += provider([p])
                        except Exception as e:  # noqa: BLE001
                            rows.append({"read_error": f"{type(e).__name__}: {e}"})
                yield pd.DataFrame([{path: p, **{n: r.get(n) for n in names}, "read_error": r.get("read_error")} for p, r in zip(part, rows, strict=True)], columns=[path, *names, "read_error"])

    return df.select(path).mapInPandas(run, f"{path} string, {schema}, read_error string")


EXIF_RECORD = "SourceFile string, DateTimeOriginal string, CreateDate string, GPSLatitude string, GPSLongitude string, GPSLatitudeRef string, GPSLongitudeRef string, Make string, Model string, ImageWidth string, ImageHeight string, Orientation string"


def _degrees(value: Column, ref: Column) -> Column:
    """Decimal degrees, or ``d m s`` of any punctuation; S and W are negative; blanks and garbage null."""
    number = value.try_cast("double")
    parts = F.regexp_extract_all(value, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)).try_cast("double"), F.lit(0.0))
    dms = F.when(F.size(parts) >= 2, at(0) + at(1) / 60 + at(2) / 3600)
    size = F.coalesce(number, dms)
    south = F.upper(F.coalesce(F.regexp_extract(value, r"([NSEWnsew])\s*$", 1), F.lit(""))).isin("S", "W") | F.upper(F.substring(F.coalesce(ref, F.lit("")), 1, 1)).isin("S", "W")
    return F.when(south, -F.abs(size)).otherwise(size)


def exif_records(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """Camera records (a JSON array per row) as typed rows; empty strings are null."""
    r = json_rows.select(F.explode(F.from_json(column, f"array<struct<{EXIF_RECORD.replace(' string', ':string')}>>")).alias("r")).select("r.*")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    whole = lambda c: F.col(c).try_cast("double").cast("int")
    return r.select(
        F.col("SourceFile").alias("path"),
        F.coalesce(text("DateTimeOriginal"), text("CreateDate")).alias("date_original"),
        _degrees(F.col("GPSLatitude"), F.col("GPSLatitudeRef")).alias("gps_lat"),
        _degrees(F.col("GPSLongitude"), F.col("GPSLongitudeRef")).alias("gps_lon"),
        text("Make").alias("camera_make"),
        text("Model").alias("camera_model"),
        whole("ImageWidth").alias("width"),
        whole("ImageHeight").alias("height"),
        whole("Orientation").alias("orientation"),
    )


# --- geographic tables ------------------------------------------------------------------


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    text = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    parts = F.split("value", "\t", -1)
    return text.where(F.size(parts) >= len(columns)).select("_at", *[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(columns)])


def _last(df: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("_at"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_at")


def places_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with too few fields or without numeric id and position are skipped; the last row of an id wins."""
    t = _tsv(spark, path, ["geonameid", "lat", "lon", "fcode", "cc", "admin1", "admin2", "name_en", "population"])
    num = t.select("_at", F.col("geonameid").try_cast("long").alias("geonameid"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), "fcode", "cc", "admin1", "admin2", "name_en", F.col("population").try_cast("long").alias("population"))
    good = num.where("geonameid IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    return _last(good.withColumn("name_en", F.coalesce(F.nullif("name_en", F.lit("")), F.col("geonameid").cast("string"))), ["geonameid"])


def admin1_tsv(spark: SparkSession, path: str) -> DataFrame:
    t = _tsv(spark, path, ["cc", "admin1", "geonameid", "name_en"])
    return _last(t.withColumn("geonameid", F.col("geonameid").try_cast("long")).where("geonameid IS NOT NULL"), ["cc", "admin1"])


def countries_tsv(spark: SparkSession, path: str) -> DataFrame:
    t = _tsv(spark, path, ["cc", "geonameid", "name_en"])
    return _last(t.withColumn("geonameid", F.col("geonameid").try_cast("long")).where("geonameid IS NOT NULL"), ["cc"])


def names_tsv(spark: SparkSession, path: str) -> DataFrame:
    t = _tsv(spark, path, ["geonameid", "lang", "name"])
    t = t.select("_at", F.col("geonameid").try_cast("long").alias("geonameid"), F.lower("lang").alias("lang"), "name").where("geonameid IS NOT NULL AND name <> ''")
    return _last(t, ["geonameid", "lang"])


def alternate_names(raw: DataFrame, ids: DataFrame, langs: tuple[str, ...] = ("ru", "en", "ja")) -> DataFrame:
    """(geonameid, lang, name) from rows (at, geonameid, lang, name, preferred): known ids and languages only; a preferred
    name beats others, of equal ones the last wins."""
    d = raw.where(F.col("lang").isin(*langs)).join(ids.select("geonameid"), "geonameid", "left_semi")
    w = Window.partitionBy("geonameid", "lang").orderBy(F.desc("preferred"), F.desc("at"))
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("geonameid", "lang", "name")


def name_coverage(places: DataFrame, names: DataFrame) -> DataFrame:
    """Places and named places by feature code and language."""
    total = places.groupBy("fcode").agg(F.count("*").alias("places"))
    named = places.select("geonameid", "fcode").join(names, "geonameid").groupBy("fcode", "lang").agg(F.count_distinct("geonameid").alias("named"))
    return total.join(named, "fcode", "left")


def landmark_list(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, name, country, city); a missing field is an error that tells the entry's number."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = (yaml.safe_load(f) or {}).get("landmarks") or []
    for k, r in enumerate(rows, 1):
        lacking = [c for c in ("prompt", "name", "country", "city") if not (r or {}).get(c)]
        if lacking:
            raise ValueError(f"landmark {k} lacks {', '.join(lacking)}")
    return spark.createDataFrame([(r["prompt"], r["name"], r["country"], r["city"]) for r in rows], "prompt string, name string, country string, city string")


#: Which part of an answer is the city, and which the district (fixed names, the first that is there counts).
CITY_PARTS, DISTRICT_PARTS = ("city", "town", "village", "municipality"), ("suburb", "city_district", "neighbourhood", "quarter")
GEOCODED = "lat_r double, lon_r double, country string, country_name string, city string, district_name string"


def http_geocoder(address: str, agent: str, lang: str = "en", retries: int = 2, timeout: float = 10) -> Callable[[float, float], dict[str, str]]:
    """A ``fetch`` for :func:`geocode_online` that asks a reverse geocoding service; a failed request is tried again."""
    import json
    import time
    import urllib.parse
    import urllib.request

    def fetch(lat: float, lon: float) -> dict[str, str]:
        query = urllib.parse.urlencode({"lat": lat, "lon": lon, "format": "jsonv2", "accept-language": lang})
        for left in range(retries, -1, -1):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{address}?{query}", headers={"User-Agent": agent}), timeout=timeout) as answer:
                    return json.load(answer).get("address") or {}
            except OSError:
                if not left:
                    raise
                time.sleep(1.0)
        return {}

    return fetch


def geocode_online(points: DataFrame, fetch: Callable[[float, float], dict[str, str]], digits: int = 3, known: DataFrame | None = None, interval: float = 0.0) -> DataFrame:
    """(lat_r, lon_r, country, country_name, city, district_name) for distinct rounded positions.

    ``fetch`` is called on the driver, one request at a time and at least ``interval`` seconds apart, as
    public services ask, and may fail for a position. Cells in ``known``, an earlier result, are not asked again.
    """
    import time

    cells = points.select(F.bround("lat", digits).alias("lat_r"), F.bround("lon", digits).alias("lon_r")).where("lat_r IS NOT NULL AND lon_r IS NOT NULL").dropDuplicates()
    asked = cells if known is None else cells.join(known.select("lat_r", "lon_r"), ["lat_r", "lon_r"], "left_anti")
    first = lambda a, keys: next((a[k] for k in keys if a.get(k)), None)
    rows, last = [], None
    for r in asked.toLocalIterator():
        if last is not None and interval:
            time.sleep(max(0.0, last + interval - time.monotonic()))
        last = time.monotonic()
        try:
            a = fetch(r.lat_r, r.lon_r) or {}
        except Exception:  # noqa: BLE001  an unreachable service leaves the position unknown
            a = {}
        cc = (a.get("country_code") or "").upper() or None
        rows.append((r.lat_r, r.lon_r, cc, a.get("country"), first(a, CITY_PARTS), first(a, DISTRICT_PARTS)))
    new = points.sparkSession.createDataFrame(rows, GEOCODED)
    return new if known is None else known.join(cells, ["lat_r", "lon_r"], "left_semi").unionByName(new)


# --- tables for places from raw dumps -----------------------------------------------------------

#: Columns of the dump of places that are kept, by their places in it (fixed).
PLACE_COLUMNS = {"geonameid": 0, "lat": 4, "lon": 5, "fcode": 7, "cc": 8, "admin1": 10, "admin2": 11, "name_en": 2, "population": 14}


def raw_lines(spark: SparkSession, path: str, least: int) -> DataFrame:
    """(at, f): fields of the lines that are no comments and have at least ``least``."""
    text = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return text.where(~F.col("value").startswith("#")).select("at", F.split("value", "\t", -1).alias("f")).where(F.size("f") >= least)


def build_places(spark: SparkSession, path: str) -> DataFrame:
    return raw_lines(spark, path, 15).select(*[F.get("f", F.lit(k)).alias(c) for c, k in PLACE_COLUMNS.items()])


def build_admin1(spark: SparkSession, path: str) -> DataFrame:
    """(cc, admin1, geonameid, name_en) from lines ``CC.code, name, ascii name, id``; codes without a dot are left out."""
    code = F.split(F.get("f", F.lit(0)), r"\.", 2)
    d = raw_lines(spark, path, 4).where(F.size(code) == 2)
    return d.select(F.get(code, F.lit(0)).alias("cc"), F.get(code, F.lit(1)).alias("admin1"), F.get("f", F.lit(3)).alias("geonameid"), F.get("f", F.lit(2)).alias("name_en"))


def build_countries(spark: SparkSession, path: str) -> DataFrame:
    """(cc, geonameid, name_en) from the list of countries; rows without id are left out."""
    d = raw_lines(spark, path, 17).select(F.get("f", F.lit(0)).alias("cc"), F.get("f", F.lit(16)).alias("geonameid"), F.get("f", F.lit(4)).alias("name_en"))
    return d.where("geonameid <> ''")


def build_names(spark: SparkSession, path: str, ids: DataFrame, langs: tuple[str, ...] = ("ru", "en", "ja")) -> DataFrame:
    f = lambda k: F.get("f", F.lit(k))
    raw = raw_lines(spark, path, 4).select("at", f(1).try_cast("long").alias("geonameid"), F.lower(f(2)).alias("lang"), f(3).alias("name"), F.coalesce(f(4) == "1", F.lit(False)).alias("preferred"))
    return alternate_names(raw, ids, langs)


def write_tsv(table: DataFrame, folder: str) -> None:
    """Tab-separated text that the readers above read back."""
    table.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]).alias("value")).write.mode("overwrite").text(folder)
