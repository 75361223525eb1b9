"""The plan: where each file goes, and under which name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import year_of
from tidemark.functions.geometry import bbox_area
from tidemark.functions.text import below, sanitize
from tidemark.functions.words import country, folder
from tidemark.operators.grouping import numbered, quality_order
from tidemark.sources.tables import stage

MODES = ("city", "person", "event")
NOT_ELIGIBLE = ("document", "junk", "not_personal", "dedup_delete")


def persons_of(faces: DataFrame) -> DataFrame:
    """(file_id, persons): labels by falling size of their largest face, then name. ``faces``: (file_id, label, bbox)."""
    largest = faces.groupBy("file_id", "label").agg(F.max(bbox_area(F.col("bbox"))).alias("area"))
    return largest.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("a"), "label"))), lambda x: x["label"]).alias("persons"))


def event_of(event_files: DataFrame, events: DataFrame) -> DataFrame:
    """(file_id, event, event_year): the earliest event of each file."""
    joined = event_files.join(events.select(F.col("id").alias("event_id"), "started_at", "name"), "event_id")
    first = joined.groupBy("file_id").agg(F.min(F.struct("started_at", "event_id", "name")).alias("e"))
    return first.select("file_id", F.col("e.name").alias("event"), F.date_format("e.started_at", "yyyy").alias("event_year"))


def assemble(files: DataFrame, places: DataFrame, media_class: DataFrame, choice: DataFrame, persons: DataFrame | None = None, events: DataFrame | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Canonical files with all that routing looks at: three left joins by file, two more for persons and events."""
    d = files.where(F.col("dup_of").isNull() & F.col("error").isNull())
    for x in exclude or []:
        d = d.where(~below(F.col("path"), x))
    d = d.join(places.withColumnRenamed("file_id", "id").withColumnRenamed("confidence", "place_confidence"), "id", "left")
    d = d.join(media_class.select(F.col("file_id").alias("id"), F.col("verdict").alias("junk_verdict"), F.col("source").alias("junk_source")), "id", "left")
    d = d.join(choice.select(F.col("file_id").alias("id"), F.col("action").alias("dedup_action")), "id", "left")
    d = d.join(persons.withColumnRenamed("file_id", "id"), "id", "left") if persons is not None else d.withColumn("persons", F.lit(None).cast("array<string>"))
    if events is not None:
        return d.join(events.withColumnRenamed("file_id", "id"), "id", "left")
    return d.withColumn("event", F.lit(None).cast("string")).withColumn("event_year", F.lit(None).cast("string"))


def route(d: DataFrame, mode: str, multi_person: str = "primary", lang: str = "en", drop_unlocalized_district: bool = True) -> DataFrame:
    """``parts`` (folders below the root) and ``reason``, by the first rule that applies.

    A user's decision to delete, films, documents, products and other verdicts come before the
    mode. ``city_name``/``district_label``/``district_exact`` are used where present (localised names).
    """
    if mode not in MODES or multi_person not in ("primary", "shared_folder"):
        raise ValueError(f"unknown mode {mode!r} or {multi_person!r}")
    name = lambda k: F.lit(folder(k, lang))
    year = year_of(F.col("taken_at"), F.col("taken_at_confidence"))
    optional = lambda c, kind="string": F.col(c) if c in d.columns else F.lit(None).cast(kind)
    unsorted = lambda k: F.array(name("unsorted"), name(k))

    rules: list[tuple[Column, Column, Column | str]] = [
        (F.col("dedup_action") == "to_delete", F.array(name("to_delete")), "dedup_delete"),
        (F.col("not_personal"), unsorted("not_personal"), "not_personal"),
        (F.col("junk_verdict") == "document", F.array(name("documents")), "document"),
        (F.col("junk_verdict") == "product", F.array(name("products")), "product"),
        (F.col("junk_verdict") != "photo", F.array(name("unsorted"), name("junk"), sanitize(F.col("junk_verdict"))), "junk"),
    ]
    if mode == "event":
        event_year = F.coalesce("event_year", year)
        rules += [
            (F.col("event").isNull() & year.isNull(), unsorted("low_date"), "low_date"),
            (F.col("event").isNull(), F.array(year, F.date_format("taken_at", "MM")), "no_event"),
            (event_year.isNull(), unsorted("low_date"), "low_date"),
            (F.lit(True), F.array(event_year, sanitize(F.col("event"))), "event"),
        ]
    else:
        rules.append((year.isNull(), unsorted("low_date"), "low_date"))
    if mode == "city":
        land = sanitize(F.coalesce(optional("country_name"), country(F.col("country"), lang), F.lit("Unknown")))
        city = sanitize(F.coalesce(optional("city_name"), F.col("city")))
        exact = F.coalesce(optional("district_exact", "boolean"), F.lit(False)) if drop_unlocalized_district else F.lit(True)
        by_id = optional("district_geonameid", "long").isNotNull()
        district = F.when(by_id, F.when(exact, sanitize(optional("district_label")))).when(F.coalesce(optional("district_name"), F.lit("")) != "", sanitize(optional("district_name")))
        rules += [
            (F.col("city").isNull() | (F.coalesce("place_confidence", F.lit("unknown")) == "unknown"), unsorted("no_place"), "no_place"),
            (F.lit(True), F.array_compact(F.array(land, city, year, district)), "city"),
        ]
    if mode == "person":
        n = F.coalesce(F.size("persons"), F.lit(0))
        first = sanitize(F.get("persons", F.lit(0)))
        several = (F.array(name("shared"), year), "person_shared") if multi_person == "shared_folder" else (F.array(first, year), "person_primary")
        rules += [(n < 1, unsorted("no_faces"), "no_faces"), (n == 1, F.array(first, year), "person"), (F.lit(True), *several)]
    parts, reason = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for when, where, why in reversed(rules):
        hit = F.coalesce(when, F.lit(False))
        parts, reason = F.when(hit, where).otherwise(parts), F.when(hit, F.lit(why)).otherwise(reason)
    return d.withColumn("parts", parts).withColumn("reason", reason)


def near_dup_roles(planned: DataFrame, groups: DataFrame, delete: bool = False) -> DataFrame:
    """(id, near_dup_group, near_dup_role): groups trimmed to eligible files, at least two left; the best is ``kept``,
    the others are ``moved`` or, with ``delete``, ``deleted``.

    ``groups``: (group_no, id). Numbers follow the order of the groups that are left.
    """
    eligible = planned.where(~F.col("reason").isin(*NOT_ELIGIBLE)).select("id", "width", "height", "size")
    members = groups.join(eligible, "id")
    w = Window.partitionBy("group_no")
    kept = members.withColumn("n", F.count("*").over(w)).where("n >= 2")
    best = quality_order(F.col("width"), F.col("height"), F.col("size"), F.col("id"))
    ranked = kept.withColumn("r", F.row_number().over(w.orderBy(*best)))
    numbers = numbered(ranked.select("group_no").distinct(), ["group_no"], "near_dup_group")
    role = F.when(F.col("r") == 1, "kept").otherwise("deleted" if delete else "moved")
    return ranked.join(numbers, "group_no").select("id", F.col("near_dup_group").cast("int").alias("near_dup_group"), role.alias("near_dup_role"))


def route_near_dups(routed: DataFrame, groups: DataFrame, lang: str = "en", delete: bool = False) -> DataFrame:
    """Routed files with their near-duplicate roles; those that are not kept go to the folder of duplicates, and say so."""
    d = routed.join(near_dup_roles(routed, groups, delete), "id", "left")
    worse = F.coalesce(F.col("near_dup_role") != "kept", F.lit(False))
    d = d.withColumn("parts", F.when(worse, F.array(F.lit(folder("duplicates", lang)))).otherwise(F.col("parts")))
    return d.withColumn("reason", F.when(worse, F.lit("near_dup_delete" if delete else "near_dup")).otherwise(F.col("reason")))


def assign_targets(d: DataFrame, folder_col: str = "folder", name: str = "name", order: str = "path", taken: DataFrame | None = None) -> DataFrame:
    """``target``: folder/name without collisions: the first by ``order`` keeps its name, the next get ``_1``, ``_2``...

    Names that end in ``_n`` by nature, and names on disk (``taken``: folder, name), are skipped. A
    file already in place (``path`` = folder/name) stays and claims nothing. Only folders in which
    a numbered name would meet another name leave the built-in functions.
    """
    d = d.withColumn("_want", F.concat_ws("/", folder_col, name)).withColumn("_home", F.col("path") == F.col("_want"))
    stem, ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("_want", "_home").orderBy(order, "id")) - 1)
    numbered = F.concat(F.concat_ws("/", folder_col, stem), F.lit("_"), F.col("_n").cast("string"), ext)
    d = d.withColumn("target", F.when(F.col("_home"), F.col("path")).when(F.col("_n") == 0, F.col("_want")).otherwise(numbered))
    # Written once: what follows reads it several times, and what it was made from is a join of many tables.
    d = stage(d, "plan-named")
    home, away = d.where("_home"), d.where("NOT _home")
    # Folders where a numbered name meets a wanted one, or any name one on disk, are settled in order.
    clash = away.where("_n > 0").join(away.select(F.col("_want").alias("target")).distinct(), "target", "left_semi").select(folder_col)
    if taken is not None:
        on = taken.select(F.concat_ws("/", "folder", "name").alias("target"))
        clash = clash.union(away.join(on, "target", "left_semi").select(folder_col))
    busy = stage(clash.distinct(), "plan-busy")
    if busy.isEmpty():
        return d.drop("_want", "_home", "_n")
    calm = away.join(busy, folder_col, "left_anti")
    rows = away.join(busy, folder_col, "left_semi").select(F.col(folder_col).alias("folder"), F.col(name).alias("name"), F.col(order).alias("ord"), "id")
    listing = taken if taken is not None else d.sparkSession.createDataFrame([], "folder string, name string")
    on_disk = listing.select("folder", "name").join(busy.select(F.col(folder_col).alias("folder")), "folder", "left_semi")

    def settle(files: pd.DataFrame, disk: pd.DataFrame) -> pd.DataFrame:
        claimed, upto, out = set(disk["name"]), {}, []
        for r in files.sort_values(["ord", "id"]).itertuples():
            cand, n = r.name, upto.get(r.name, 0)
            if cand in claimed:
                stem, dot, ext = r.name.rpartition(".")
                stem, ext = (stem, dot + ext) if stem else (r.name, "")
                while cand in claimed:
                    n += 1
                    cand = f"{stem}_{n}{ext}"
                upto[r.name] = n
            claimed.add(cand)
            out.append((r.id, f"{r.folder}/{cand}"))
        return pd.DataFrame(out, columns=["id", "target"])

    settled = rows.groupBy("folder").cogroup(on_disk.groupBy("folder")).applyInPandas(settle, "id long, target string")
    crowded = away.drop("target").join(busy, folder_col, "left_semi").join(settled, "id")
    return home.drop("_want", "_home", "_n").unionByName(calm.drop("_want", "_home", "_n")).unionByName(crowded.drop("_want", "_home", "_n"))


def plan(d: DataFrame, mode: str, root: str, groups: DataFrame | None = None, taken: DataFrame | None = None, delete_worse: bool = False, **routing) -> DataFrame:
    """The plan of assembled files: path, target, reason; with ``groups`` near duplicates are routed to a folder of their own."""
    r = route(d, mode, **routing)
    if groups is not None:
        r = route_near_dups(r, groups, routing.get("lang", "en"), delete_worse)
    r = r.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("folder", F.concat_ws("/", F.lit(root.rstrip("/")), F.array_join("parts", "/")))
    return assign_targets(r, taken=taken)


def album(d: DataFrame, root: str, name: str, members: DataFrame, expressions: list[str] | None = None, names=None, move: bool = False, n_persons: DataFrame | None = None) -> DataFrame:
    """A flat folder of the files in ``members`` (id) that pass the filter. Moving leaves out files with two or more named persons."""
    from tidemark.plans import where

    s = where.apply(d, expressions or [], names).join(members.select("id").distinct(), "id", "left_semi")
    if move and n_persons is not None:
        s = s.join(n_persons.where("n >= 2").select("id"), "id", "left_anti")
    s = s.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("folder", F.concat_ws("/", F.lit(root.rstrip("/")), sanitize(F.lit(name))))
    return assign_targets(s)


def events_by_selector(events: DataFrame, selector: str) -> DataFrame:
    """Events by number if there is one of that number, else all of that name without regard to case."""
    from tidemark.functions.text import casefold

    if selector.isdigit():
        hit = events.where(F.col("id") == int(selector))
        if not hit.isEmpty():
            return hit
    return events.where(casefold(F.col("name")) == selector.casefold())

