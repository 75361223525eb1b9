"""Whole runs: from the tables of an index to a plan, its reports, and the moves; duplicates to look at, and their end."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.text import basename, below
from tidemark.functions.words import LANGUAGES
from tidemark.operators import events, graphs
from tidemark.operators.classify import detected_faces
from tidemark.operators.clusters import cluster_faces
from tidemark.operators.grouping import best_per_group, quality_order
from tidemark.operators.nearest import city_names, country_codes
from tidemark.operators.places import resolve_places
from tidemark.plans import journal, reports, where
from tidemark.plans.plan import assemble, event_of, persons_of, plan
from tidemark.sources.files import geocode_online
from tidemark.sources.tables import stage


@dataclass
class Tables:
    """An index: files, places, verdicts, choices, faces under clusters, events and their files."""

    files: DataFrame
    places: DataFrame
    media_class: DataFrame
    choice: DataFrame
    faces: DataFrame
    clusters: DataFrame
    events: DataFrame
    event_files: DataFrame
    dims: dict[str, DataFrame] | None = None  # names of places, for localised filters


def near_dup_groups(files: DataFrame, most: int) -> DataFrame:
    photos = files.where("media_type = 'photo' AND phash IS NOT NULL AND dup_of IS NULL AND error IS NULL")
    return graphs.near_groups(photos, "id", "phash", "path", "size", most)


def make_plan(t: Tables, mode: str, root: str, cfg: Config | None = None, expressions: list[str] | None = None, exclude: list[str] | None = None, dedupe: bool = False, delete_worse: bool = False, taken: DataFrame | None = None) -> DataFrame:
    """Files that pass the filters, with targets below ``root``; with ``dedupe`` near duplicates go to a folder of their own."""
    cfg = cfg or Config()
    people = graphs.person_files(t.clusters, t.faces)
    held = t.event_files.join(t.events.select(F.col("id").alias("event_id"), "name"), "event_id").select("file_id", "name")
    d = assemble(t.files, t.places, t.media_class, t.choice, persons_of(people), event_of(t.event_files, t.events), exclude)
    if expressions:
        lang = cfg.language
        names = where.Names(country_codes(t.dims, lang) if t.dims else None, city_names(t.dims, lang) if t.dims else None, people.select("file_id", "label"), held)
        d = where.apply(d, expressions, names)
    groups = near_dup_groups(t.files, cfg.index.phash_max_distance) if dedupe else None
    return plan(d, mode, root, groups, taken, delete_worse, multi_person=cfg.sort.multi_person, lang=cfg.language, drop_unlocalized_district=cfg.sort.drop_unlocalized_district)


def plan_and_sort(t: Tables, mode: str, root: str, folder: str, ledger: journal.Ledger | None = None, operation: str = "move", **planning) -> tuple[DataFrame, journal.Report | None]:
    """The plan, written as CSV and HTML below ``folder``; with a ledger it is carried out, rows by path."""
    made = stage(make_plan(t, mode, root, **planning), "plan")
    os.makedirs(folder, exist_ok=True)
    reports.write_plan_csv(made, f"{folder}/plan_{mode}.csv")
    reports.write_plan_html(made, f"{folder}/plan_{mode}.html", root)
    if ledger is None:
        return made, None
    delete = F.col("near_dup_role") == "deleted" if "near_dup_role" in made.columns else F.lit(False)
    digest = F.col("hash") if "hash" in made.columns else F.lit(None).cast("string")
    rows = made.orderBy("path", "id").select("id", "path", "target", digest.alias("hash"), F.coalesce(delete, F.lit(False)).alias("delete"))
    batch = (ledger.events().agg(F.max("batch_id")).first()[0] or 0) + 1
    return made, journal.apply(ledger, batch, (tuple(r) for r in rows.toLocalIterator()), operation)


def moved_paths(files: DataFrame, ledger: journal.Ledger, batch_id: int, back: bool = False) -> DataFrame:
    """``files`` with the new paths of a batch's done moves, or with the old ones of those taken back."""
    status, to = ("undone", "src") if back else ("done", "dst")
    hit = ledger.latest().where((F.col("batch_id") == batch_id) & (F.col("status") == status)).select(F.col("file_id").alias("id"), F.col(to).alias("_to"))
    return files.join(hit, "id", "left").withColumn("path", F.coalesce("_to", "path")).drop("_to")


def counters(made: DataFrame, root: str) -> DataFrame:
    """One row: files, folders, files in place, and files by reason as a map."""
    by = made.groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))  # reasons are few
    folder = F.regexp_replace("target", "/[^/]*$", "")
    one = made.agg(F.count("*").alias("files"), F.count_distinct(folder).alias("folders"), F.count(F.when(F.col("path") == F.col("target"), 1)).alias("in_place"), F.count(F.when(below(F.col("target"), root), 1)).alias("below_root"))
    return one.crossJoin(by)  # one row each


# --- stages by the settings -------------------------------------------------------------------


def update_places(files: DataFrame, places: DataFrame, cfg: Config) -> DataFrame:
    return resolve_places(files, places, cfg.geo.session_gap_hours)


def ask_places(points: DataFrame, fetch: Callable[[float, float], dict[str, str]], cfg: Config, known: DataFrame | None = None, interval: float = 1.0) -> DataFrame:
    return geocode_online(points, fetch, cfg.geo.cache_coord_digits, known, interval)


def update_events(located: DataFrame, cfg: Config, manual_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    e = cfg.events
    return events.build(located, e.gap_hours, e.trip_merge_gap_hours, e.min_event_size, e.trip_merge_max_km, manual_files)


def update_faces(hits: DataFrame, cfg: Config) -> DataFrame:
    return detected_faces(hits, cfg.faces.det_threshold, cfg.faces.min_face_px)


def update_clusters(faces: DataFrame, cfg: Config, width: int = 512) -> DataFrame:
    return cluster_faces(faces, cfg.faces.min_cluster_size, cfg.faces.max_distance, width)


# --- duplicates to look at ----------------------------------------------------------------


def dupes_payload(files: DataFrame, choice: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_no, place, file_id, name, width, height, size, action, recommended): near duplicates with what was decided on them.

    The best frame of a group, by pixels, then size, then id, is recommended.
    """
    own = groups.join(files.select("id", "path", "width", "height", "size"), "id").join(choice.select(F.col("file_id").alias("id"), "action"), "id", "left")
    best = best_per_group(own, ["group_no"], quality_order(F.col("width"), F.col("height"), F.col("size"), F.col("id"))).select("id", F.lit(True).alias("_best"))
    d = own.join(best, "id", "left")
    return d.select("group_no", "place", F.col("id").alias("file_id"), basename(F.col("path")).alias("name"), "width", "height", "size", "action", F.coalesce("_best", F.lit(False)).alias("recommended"))


def trash(files: DataFrame, choice: DataFrame, ids: DataFrame, bin_it: Callable[[str], None]) -> tuple[DataFrame, DataFrame, int]:
    """Files and choices without ``ids`` (id), whose files go to the system's bin one by one; ids that are no files any more are passed over."""
    hit = stage(files.join(ids.select("id").distinct(), "id", "left_semi").select("id", "path"), "trash")
    n = 0
    for r in hit.toLocalIterator():
        bin_it(r.path)
        n += 1
    gone = hit.select("id")
    return files.join(gone, "id", "left_anti"), choice.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_anti"), n


def trash_group(files: DataFrame, choice: DataFrame, group: DataFrame, keep: int, bin_it: Callable[[str], None]) -> tuple[DataFrame, DataFrame, int]:
    return trash(files, choice, group.where(F.col("id") != keep), bin_it)


def paths_of(files: DataFrame, ids: list[int]) -> DataFrame:
    """(id, path) of a few ids that a caller names."""
    return files.where(F.col("id").isin(ids)).select("id", "path")


def sorted_rows(rows: DataFrame, column: str, falling: bool = False) -> DataFrame:
    """Rows by a column, empty cells last either way."""
    c = F.nullif(F.col(column).cast("string"), F.lit("")).isNull()
    return rows.orderBy(c, F.desc_nulls_last(column) if falling else F.asc_nulls_last(column))


# --- what callers send -----------------------------------------------------------------------


def _whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _text(x: Any) -> bool:
    return isinstance(x, str) and bool(x.strip())


#: Fields of each request: name, what it must be, whether it may be absent.
REQUESTS: dict[str, dict[str, tuple[str, bool]]] = {
    "file": {"file_id": ("whole", False)},
    "files": {"file_ids": ("wholes", False)},
    "choice": {"file_id": ("whole", False), "action": ("action", False)},
    "group": {"group": ("wholes", False), "keep_file_id": ("whole", False)},
    "label": {"cluster_id": ("whole", False), "label": ("text", False)},
    "merge": {"src": ("whole", False), "dst": ("whole", False)},
    "rename": {"event_id": ("whole", False), "name": ("text", False)},
    "event": {"name": ("text", False), "start": ("text", False), "end": ("text", False)},
    "plan": {"mode": ("mode", False), "dest": ("text", False), "where": ("texts", True), "apply": ("flag", True)},
    "album": {"name": ("text", False), "event": ("text", True), "where": ("texts", True), "move": ("flag", True)},
    "undo": {"batch_id": ("whole", True)},
    "language": {"language": ("language", False)},
}
_KINDS: dict[str, Callable[[Any], bool]] = {
    "whole": _whole,
    "wholes": lambda x: isinstance(x, list) and bool(x) and all(map(_whole, x)),
    "text": _text,
    "texts": lambda x: isinstance(x, list) and all(map(_text, x)),
    "flag": lambda x: isinstance(x, bool),
    "mode": lambda x: x in ("city", "person", "event"),
    "action": lambda x: x is None or x in ("keep", "to_delete"),
    "language": lambda x: x in LANGUAGES,
}


def request(kind: str, body: Any) -> dict[str, Any]:
    """The fields of a request, or ValueError that names the first wrong one; ids are distinct, in their order."""
    if not isinstance(body, dict):
        raise ValueError(f"{kind}: not an object")
    out = {}
    for name, (what, optional) in REQUESTS[kind].items():
        if optional and body.get(name) is None:
            continue
        if name not in body or not _KINDS[what](body[name]):
            raise ValueError(f"{kind}: {name} must be {what}")
        out[name] = list(dict.fromkeys(body[name])) if what == "wholes" else body[name]
    if kind == "group" and out["keep_file_id"] not in out["group"]:
        raise ValueError("group: keep_file_id must be in the group")
    return out


def save_language(path: str, lang: str) -> None:
    """Set ``language`` in a settings file; other lines, and comments, stay as they are. Unknown languages mean English."""
    line = f"language: {lang if lang in LANGUAGES else 'en'}"
    old = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
    new, n = re.subn(r"(?m)^language:[^\n]*$", line, old, count=1)
    if not n:
        new = (old.rstrip("\n") + "\n" if old.strip() else "") + line + "\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(new)
