"""Commands over an index: a folder of Parquet tables, one for each name in ``schema.TABLES``.

``python -m tidemark.cli --index FOLDER COMMAND ...``
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config, schema
from tidemark.operators import events, graphs, grouping, naming, nearest
from tidemark.plans import index, journal, plan, run, where
from tidemark.sources import camera, files, images, tables


class Store:
    """The tables of an index, the geographic tables and the settings."""

    def __init__(self, spark: SparkSession, folder: str, cfg: config.Config | None = None, geo: str | None = None):
        self.spark, self.folder, self.cfg, self.geo = spark, folder.rstrip("/"), cfg or config.Config(), geo
        self.ledger = journal.Ledger(spark, self.path("moves"))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        fs, path = tables._fs(self.spark, self.path(name))
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema.TABLES[name])
        return schema.evolve(self.spark.read.parquet(self.path(name)), schema.TABLES[name])

    def write(self, name: str, df: DataFrame) -> None:
        tables.replace(tables.stage(schema.evolve(df, schema.TABLES[name]), name), self.path(name))

    def dims(self) -> dict[str, DataFrame] | None:
        if not self.geo:
            return None
        at = lambda name: f"{self.geo}/{name}.tsv"
        readers = {"places": files.places_tsv, "names": files.names_tsv, "admin1": files.admin1_tsv, "countries": files.countries_tsv}
        return {name: read(self.spark, at(name)) for name, read in readers.items()}

    def tables(self) -> run.Tables:
        t = {n: self.read(n) for n in ("files", "places", "media_class", "dedup_choice", "faces", "face_clusters", "events", "event_files")}
        return run.Tables(t["files"], t["places"], t["media_class"], t["dedup_choice"], t["faces"], t["face_clusters"], t["events"], t["event_files"], self.dims())


def do_index(s: Store, a: argparse.Namespace) -> None:
    reader: Callable | None = None if a.no_camera else lambda paths: camera.usual_reader()(paths)
    found = index.update_index(s.spark, s.read("files"), a.roots, s.cfg, reader)
    s.write("files", index.assign_duplicates(found, s.cfg.dedup.canonical_strategy))


def do_stats(s: Store, a: argparse.Namespace) -> DataFrame:
    return grouping.coverage(s.read("files"))


def do_dupes(s: Store, a: argparse.Namespace) -> DataFrame:
    f = s.read("files")
    if a.near:
        return run.dupes_payload(f, s.read("dedup_choice"), run.near_dup_groups(f, s.cfg.index.phash_max_distance)).orderBy("group_no", "place")
    kept = f.select(F.col("id").alias("dup_of"), F.col("path").alias("kept"))
    return f.select("dup_of", "path").join(kept, "dup_of").select("kept", "path").orderBy("kept", "path")


def do_geo(s: Store, a: argparse.Namespace) -> None:
    dims = s.dims()
    if dims is None:
        raise SystemExit("geo: --geo names the folder of geographic tables")
    found, lang = tables.stage(run.update_places(s.read("files"), dims["places"], s.cfg), "places"), s.cfg.language
    for key, name in (("city_geonameid", "city"), ("district_geonameid", "district_name")):
        named = nearest.localized(found.select(key).where(F.col(key).isNotNull()).distinct(), key, dims, lang, name)
        found = found.join(named.select(key, name), key, "left")
    lands = nearest.about_cities(found.select("city_geonameid").distinct().where("city_geonameid IS NOT NULL"), dims, lang).select("city_geonameid", "country_name")
    s.write("places", found.join(lands, "city_geonameid", "left"))


def do_phash(s: Store, a: argparse.Namespace, decode: images.Decoder = images.pillow_pixels) -> None:
    f = s.read("files")
    new = images.with_phashes(index.pending_phash(f), decode).withColumnRenamed("phash", "_new")
    s.write("files", f.join(new, "id", "left").withColumn("phash", F.coalesce("phash", "_new")))


def do_events(s: Store, a: argparse.Namespace) -> None:
    old, old_files, dims = s.read("events"), s.read("event_files"), s.dims()
    located = events.with_locality(s.read("files"), s.read("places").drop("confidence", "updated_at"))
    if dims is not None:
        known = nearest.about_cities(located.select("city_geonameid").distinct().where("city_geonameid IS NOT NULL"), dims, s.cfg.language)
        located = located.drop("country_name").join(known, "city_geonameid", "left")
    else:
        located = located.withColumns({c: F.lit(None).cast(k) for c, k in (("region", "string"), ("lat", "double"), ("lon", "double"))})
    manual = old.where("origin = 'manual'")
    theirs = old_files.join(manual.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    new, new_files = run.update_events(located.withColumn("place_name", F.coalesce("city", "district_name")), s.cfg, theirs)
    top = manual.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top  # automatic events are numbered after manual ones
    new, new_files = new.withColumn("id", F.col("id") + top), new_files.withColumn("event_id", F.col("event_id") + top)
    kept = events.keep_manual_names(new, new_files, old.where("origin <> 'manual'"), old_files)
    both = tables.stage(kept.unionByName(manual), "events"), tables.stage(new_files.unionByName(theirs), "event-files")  # they read what is written next
    s.write("events", both[0])
    s.write("event_files", both[1])


def do_name_events(s: Store, a: argparse.Namespace) -> dict[str, int]:
    ev = s.read("events")
    named, stats = naming.name_events(ev, naming.by_template(ev))
    s.write("events", named)
    return stats


def do_rename(s: Store, a: argparse.Namespace) -> None:
    s.write("events", events.rename(s.read("events"), a.event, a.name))


def do_add_event(s: Store, a: argparse.Namespace) -> None:
    ev, ef = events.add_manual(s.read("events"), s.read("event_files"), s.read("files"), a.name, a.start, a.end)
    ev, ef = tables.stage(ev, "events"), tables.stage(ef, "event-files")
    s.write("events", ev)
    s.write("event_files", ef)


def do_label(s: Store, a: argparse.Namespace) -> None:
    s.write("face_clusters", graphs.label_root(s.read("face_clusters"), a.cluster, a.label))


def do_merge(s: Store, a: argparse.Namespace) -> None:
    s.write("face_clusters", graphs.merge_clusters(s.read("face_clusters"), a.src, a.dst))


def do_sort(s: Store, a: argparse.Namespace) -> journal.Report | None:
    operation = "copy" if a.copy else "move"
    made, report = run.plan_and_sort(s.tables(), a.by, a.dest, a.reports or s.path("reports"), s.ledger if a.apply else None, operation, cfg=s.cfg, expressions=a.where, exclude=a.exclude, dedupe=a.dedupe, delete_worse=a.delete_worse)
    if report is not None and operation == "move":
        s.write("files", run.moved_paths(s.read("files"), s.ledger, s.ledger.last_batch() or 0))
    return report


def do_album(s: Store, a: argparse.Namespace) -> journal.Report | None:
    t = s.tables()
    people = graphs.person_files(t.clusters, t.faces)
    chosen = plan.events_by_selector(t.events, a.event).select(F.col("id").alias("event_id")) if a.event else None
    members = (t.event_files.join(chosen, "event_id", "left_semi") if chosen is not None else t.files.select(F.col("id").alias("file_id"))).select(F.col("file_id").alias("id"))
    d = plan.assemble(t.files, t.places, t.media_class, t.choice)
    held = t.event_files.join(t.events.select(F.col("id").alias("event_id"), "name"), "event_id").select("file_id", "name")
    known = where.Names(persons=people.select("file_id", "label"), events=held)
    n = people.groupBy(F.col("file_id").alias("id")).agg(F.count_distinct("label").alias("n"))
    made = tables.stage(plan.album(d, a.dest, a.name, members, a.where, known, a.move, n), "album")
    if not a.apply:
        return None
    batch = (s.ledger.events().agg(F.max("batch_id")).first()[0] or 0) + 1
    rows = made.orderBy("path", "id").select("id", "path", "target", "hash").toLocalIterator()
    return journal.apply(s.ledger, batch, (tuple(r) for r in rows), "move" if a.move else "copy")


def do_undo(s: Store, a: argparse.Namespace) -> journal.Report:
    batch = a.batch if a.batch is not None else s.ledger.last_batch()
    report = journal.undo(s.ledger, batch, "copy" if a.copy else "move")
    if batch is not None and not a.copy:
        s.write("files", run.moved_paths(s.read("files"), s.ledger, batch, back=True))
    return report


def do_reset(s: Store, a: argparse.Namespace) -> None:
    for name in a.tables or [n for n in schema.TABLES if n not in ("files", "moves")]:
        tables.reset(s.spark, s.path(name), schema.TABLES[name])


def do_run(s: Store, a: argparse.Namespace) -> None:
    """All stages that need no model, in their order."""
    do_index(s, a)
    if s.geo:
        do_geo(s, a)
    do_phash(s, a)
    do_events(s, a)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--index", required=True, help="folder of the index")
    p.add_argument("--settings", help="settings file")
    p.add_argument("--geo", help="folder of geographic tables")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, do: Callable, *arguments: tuple) -> None:
        c = sub.add_parser(name)
        c.set_defaults(do=do)
        for flags, options in arguments:
            c.add_argument(*flags.split(), **options)

    flag = {"action": "store_true"}
    many = {"action": "append", "default": []}
    roots = ("roots", {"nargs": "+"}), ("--no-camera", flag)
    add("index", do_index, *roots)
    add("stats", do_stats)
    add("dupes", do_dupes, ("--near", flag))
    add("geo", do_geo)
    add("phash", do_phash)
    add("events", do_events)
    add("name-events", do_name_events)
    add("rename-event", do_rename, ("event", {"type": int}), ("name", {}))
    add("add-event", do_add_event, ("name", {}), ("start", {}), ("end", {}))
    add("label", do_label, ("cluster", {"type": int}), ("label", {}))
    add("merge", do_merge, ("src", {"type": int}), ("dst", {"type": int}))
    add("sort", do_sort, ("dest", {}), ("--by", {"choices": plan.MODES, "default": "city"}), ("--where", many), ("--exclude", many), ("--apply", flag), ("--copy", flag), ("--dedupe", flag), ("--delete-worse", flag), ("--reports", {}))
    add("album", do_album, ("name", {}), ("dest", {}), ("--event", {}), ("--where", many), ("--apply", flag), ("--move", flag))
    add("undo", do_undo, ("--batch", {"type": int}), ("--copy", flag))
    add("reset", do_reset, ("tables", {"nargs": "*"}))
    add("run", do_run, *roots)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None):
    """Carry out a command; tables that it answers with are shown, and returned."""
    from tidemark.session import session

    a = parser().parse_args(arguments)
    cfg = config.load(a.settings) if a.settings and os.path.exists(a.settings) else None
    out = a.do(Store(spark or session(), a.index, cfg, a.geo), a)
    if isinstance(out, DataFrame):
        out.show(50, truncate=False)
    elif out is not None:
        print(out)
    return out


if __name__ == "__main__":
    main()
