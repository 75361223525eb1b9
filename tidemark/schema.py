"""Tables of the index and the filter that every derived table starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = (
    "id long, path string, size long, mtime double, ext string, media_type string, hash string, hash_algo string, phash string, "
    "taken_at timestamp_ntz, taken_at_source string, taken_at_confidence string, gps_lat double, gps_lon double, camera_make string, "
    "camera_model string, width int, height int, orientation int, not_personal boolean, dup_of long, error string, indexed_at string"
)
PLACES = "file_id long, country string, country_name string, city string, city_geonameid long, district_geonameid long, district_name string, confidence string, updated_at string"
FACES = "id long, file_id long, bbox array<double>, embedding array<float>, cluster_id long"
FACE_CLUSTERS = "id long, label string, merged_into long"
EVENTS = "id long, started_at timestamp_ntz, ended_at timestamp_ntz, place_city string, name string, name_is_manual boolean, origin string"
EVENT_FILES = "event_id long, file_id long"
MEDIA_CLASS = "file_id long, verdict string, source string, score double, tier string, updated_at string"
DEDUP_CHOICE = "file_id long, action string, updated_at string"
MOVE_BATCHES = "id long, mode string, dest_root string, started_at string, finished_at string, operation string"
#: Status events are appended; the latest of a move counts.
MOVES = "seq long, id long, batch_id long, file_id long, src string, dst string, hash string, status string"

TABLES = {
    "files": FILES, "places": PLACES, "faces": FACES, "face_clusters": FACE_CLUSTERS, "events": EVENTS, "event_files": EVENT_FILES,
    "media_class": MEDIA_CLASS, "dedup_choice": DEDUP_CHOICE, "move_batches": MOVE_BATCHES, "moves": MOVES,
}


def canonical(files: DataFrame) -> DataFrame:
    """Neither a duplicate nor a row with an error."""
    return files.where(F.col("dup_of").isNull() & F.col("error").isNull())


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows without parent: the integrity check in place of foreign keys."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def evolve(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones null, others dropped, types cast."""
    out = []
    for part in _fields(schema):
        name, kind = part.split(" ", 1)
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def _fields(schema: str) -> list[str]:
    return [p.strip() for p in schema.split(", ")]
