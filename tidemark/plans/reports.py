"""Lists and files for people: cards of clusters and events, duplicates, the plan as CSV and HTML."""

from __future__ import annotations

import csv
import html
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import file_uri
from tidemark.operators.graphs import roots
from tidemark.operators.grouping import best_per_group, tree_counts
from tidemark.schema import canonical

#: Columns of the plan's table (fixed names).
PLAN_COLUMNS = ["path", "taken_at", "taken_at_confidence", "country", "city", "place_confidence", "persons", "event", "junk_verdict", "junk_source", "target", "reason"]
DEDUPE_COLUMNS = ["near_dup_group", "near_dup_role"]


def cluster_cards(clusters: DataFrame, faces: DataFrame, k: int = 6) -> DataFrame:
    """All roots, empty ones too: label, faces in the whole chain, and the first ``k`` files by face."""
    r = roots(clusters)
    own = faces.where(F.size("bbox") == 4).join(r.withColumnRenamed("id", "cluster_id"), "cluster_id")
    size = own.groupBy("root").agg(F.count("*").alias("size"))
    first = own.groupBy("root", "file_id").agg(F.min("id").alias("face"))
    top = best_per_group(first, ["root"], [F.asc("face")], k).groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("face", "file_id"))), lambda x: x["file_id"]).alias("samples"))
    heads = clusters.where("merged_into IS NULL").select(F.col("id").alias("root"), "label")
    d = heads.join(size, "root", "left").join(top, "root", "left")
    return d.select("root", "label", F.coalesce("size", F.lit(0)).alias("size"), "samples").orderBy(F.desc("size"), "root")


def event_cards(events: DataFrame, event_files: DataFrame, files: DataFrame, k: int = 8) -> DataFrame:
    good = event_files.join(canonical(files).select(F.col("id").alias("file_id"), "taken_at"), "file_id")
    n = good.groupBy("event_id").agg(F.count("*").alias("n"))
    top = best_per_group(good, ["event_id"], [F.asc("taken_at"), F.asc("file_id")], k).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_id"))), lambda x: x["file_id"]).alias("samples"))
    d = events.join(n.withColumnRenamed("event_id", "id"), "id", "left").join(top.withColumnRenamed("event_id", "id"), "id", "left")
    return d.withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.desc("n"), "id")


def contact_sheet(clusters: DataFrame, faces: DataFrame, files: DataFrame, root: int) -> DataFrame:
    """Faces of a root with what was merged into it, by path."""
    own = roots(clusters).where(F.col("root") == root).select(F.col("id").alias("cluster_id"))
    return faces.join(own, "cluster_id", "left_semi").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").orderBy("path", "id")


def set_choices(choice: DataFrame, picked: DataFrame) -> DataFrame:
    """Decisions (file_id, action, updated_at) replace earlier ones; a null action withdraws one."""
    return choice.join(picked.select("file_id"), "file_id", "left_anti").unionByName(picked.where(F.col("action").isNotNull()))


#: Marks of uncertain dates, by confidence, and words for near-duplicate roles.
CONFIDENCE_MARKS = {"low": "uncertain", "medium": "from name"}
ROLE_MARKS = {"kept": "kept", "moved": "to duplicates", "deleted": "deleted"}


def _mark(c: Column, marks: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in marks.items() for x in pair]), c)


def _dots(*cells: Column) -> Column:
    """Cells that hold something, with dots between."""
    return F.concat_ws(" \u00b7 ", *[F.nullif(c, F.lit("")) for c in cells])


def date_cell(taken_at: Column, confidence: Column) -> Column:
    """The day, with a mark if it is uncertain."""
    mark = _mark(confidence, CONFIDENCE_MARKS)
    day = F.date_format(taken_at, "yyyy-MM-dd")
    return F.when(taken_at.isNull(), "no date").when(mark.isNotNull(), F.concat(day, F.lit(" ("), mark, F.lit(")"))).otherwise(day)


def geo_cell(country: Column, city: Column, lat: Column, lon: Column, confidence: Column | None = None) -> Column:
    """Place with its confidence, and position; empty without either."""
    place = F.nullif(F.concat_ws("/", F.nullif(country, F.lit("")), F.nullif(city, F.lit(""))), F.lit(""))
    if confidence is not None:
        place = F.when(F.coalesce(confidence, F.lit("")) != "", F.concat(place, F.lit(" ("), confidence, F.lit(")"))).otherwise(place)
    at = F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.4f, %.4f", lat, lon))
    return _dots(place, at)


def people_event_cell(persons: Column, event: Column) -> Column:
    return _dots(F.array_join(persons, ", "), event)


def category_cell(reason: Column, verdict: Column, role: Column) -> Column:
    """The reason, the verdict behind junk and documents, the near-duplicate role."""
    return _dots(reason, F.when(reason.isin("junk", "document"), verdict), _mark(role, ROLE_MARKS))


def as_json(plan: DataFrame) -> DataFrame:
    geo = F.nullif(F.concat_ws("/", "country", "city"), F.lit(""))
    return plan.select(F.to_json(F.struct("id", "path", "target", "reason", geo.alias("geo"))).alias("json"))


def plan_rows(plan: DataFrame) -> DataFrame:
    cols = PLAN_COLUMNS + [c for c in DEDUPE_COLUMNS if c in plan.columns]
    have = [F.col(c) if c in plan.columns else F.lit(None).cast("string").alias(c) for c in cols]
    d = plan.select(*have).withColumn("persons", F.array_join("persons", ";"))
    return d.withColumn("taken_at", F.date_format("taken_at", "yyyy-MM-dd'T'HH:mm:ss"))


def write_plan_csv(plan: DataFrame, path: str) -> None:
    """One file for a person to open: semicolons, a byte order mark, rows by path, read from the cluster as they are written."""
    d = plan_rows(plan)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f, delimiter=";")
        w.writerow(d.columns)
        for r in d.orderBy("path").toLocalIterator():
            w.writerow(["" if x is None else x for x in r])


def _optional(d: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in d.columns else F.lit(None).cast(kind)


def _tree(plan: DataFrame, files: bool) -> Iterator[str]:
    """Nested lists, folder by folder, as rows come from the cluster in order of their paths."""
    counts = tree_counts(plan.withColumn("rel", F.array_join("parts", "/")), "rel").select(F.split("prefix", "/").alias("at"), "n", F.lit("").alias("line"), F.lit(0).alias("kind"))
    rows = counts
    if files:
        cells = [
            F.regexp_replace("path", "^.*/", ""),
            date_cell(_optional(plan, "taken_at", "timestamp_ntz"), _optional(plan, "taken_at_confidence")),
            geo_cell(_optional(plan, "country"), _optional(plan, "city"), _optional(plan, "gps_lat", "double"), _optional(plan, "gps_lon", "double"), _optional(plan, "place_confidence")),
            people_event_cell(_optional(plan, "persons", "array<string>"), _optional(plan, "event")),
            category_cell(_optional(plan, "reason"), _optional(plan, "junk_verdict"), _optional(plan, "near_dup_role")),
        ]
        rows = counts.union(plan.select(F.col("parts").alias("at"), F.lit(0).cast("long"), F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in cells])), F.lit(1)))
    depth = 0
    for r in rows.orderBy("at", "kind", "line").toLocalIterator():
        if r.kind:
            yield "<p>" + " | ".join(html.escape(c) for c in json.loads(r.line)) + "</p>"
            continue
        while depth >= len(r.at):
            yield "</details>"
            depth -= 1
        yield f"<details><summary>{html.escape(r.at[-1])} ({r.n})</summary>"
        depth = len(r.at)
    yield "</details>" * depth


_HEAD = "<!doctype html><meta charset=utf-8><title>plan</title>"


def plan_tree_html(plan: DataFrame) -> str:
    """Folders of the plan with the number of files at and below each. ``plan`` has ``parts``."""
    return _HEAD + "".join(_tree(plan, False))


def near_dup_lines(plan: DataFrame) -> Iterator[str]:
    """Near duplicates by group, the kept one first."""
    if "near_dup_group" not in plan.columns:
        return
    own, group = plan.where("near_dup_group IS NOT NULL").withColumn("_o", (F.col("near_dup_role") != "kept").cast("int")), None
    for r in own.orderBy("near_dup_group", "_o", "path").toLocalIterator():
        if r.near_dup_group != group:
            group = r.near_dup_group
            yield f"<h3>Near duplicates {group}</h3>"
        yield f"<p>{html.escape(r.path)} ({html.escape(ROLE_MARKS.get(r.near_dup_role, r.near_dup_role))})</p>"


def write_plan_html(plan: DataFrame, path: str, root: str) -> None:
    """Folders, files and near duplicates as one page, written row by row."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(_HEAD + f"<h1>{html.escape(root)}</h1>")
        f.writelines(near_dup_lines(plan))
        f.writelines(_tree(plan, True))


def write_contact_sheet(sheet: DataFrame, path: str, title: str) -> int:
    """The faces of :func:`contact_sheet` as a page of pictures; returns how many."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>")
        for r in sheet.select("path", file_uri(F.col("path")).alias("uri"), "bbox").toLocalIterator():
            n += 1
            f.write(f'<figure><img loading=lazy width=200 src="{html.escape(r.uri)}"><figcaption>{html.escape(r.path)} {[round(x) for x in r.bbox or []]}</figcaption></figure>')
    return n


def index_report(plan: DataFrame) -> DataFrame:
    return plan.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct(F.regexp_replace("target", "/[^/]*$", "")).alias("folders")).orderBy(F.desc("n"), "reason")
