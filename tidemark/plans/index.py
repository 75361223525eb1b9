"""Stages from folders to tables, each a function of tables to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.dates import cascade
from tidemark.functions.text import basename, is_release
from tidemark.operators.grouping import canonical_order, mark_duplicates, numbered
from tidemark.schema import FILES, evolve
from tidemark.sources import files as source
from tidemark.sources import tables


def update_index(spark: SparkSession, old: DataFrame, roots: list[str], cfg: Config | None = None, reader: Callable | None = None, zone: str = "UTC", now: str = "") -> DataFrame:
    """The index after a scan: new and changed files are hashed, read and dated, others stay as they are.

    ``reader`` gives camera records for lists of paths (see ``read_with``); without it dates come from names and times.
    """
    cfg = cfg or Config()
    seen = tables.changes(old, source.scan(spark, roots, cfg.index))
    todo = source.with_hashes(seen.where("action <> 'skip'").drop("action"))
    schema = "date_original string, gps_lat double, gps_lon double, camera_make string, camera_model string, width int, height int, orientation int"
    if reader is not None:
        todo = todo.join(source.read_with(todo.select("path"), reader, schema), "path", "left")
    else:
        for part in schema.split(", "):
            todo = todo.withColumn(part.split(" ")[0], F.lit(None).cast(part.split(" ")[1]))
    when = cascade(F.col("date_original"), basename(F.col("path")), F.col("mtime"), zone, cfg.dates.min_year, cfg.dates.max_year)
    film = (F.col("media_type") == "video") & is_release(basename(F.col("path")))
    # The generator keeps the three fields from being computed one by one.
    todo = todo.select("*", film.alias("not_personal"), F.lit(now).alias("indexed_at"), F.inline(F.array(when))).withColumnsRenamed({"source": "taken_at_source", "confidence": "taken_at_confidence"})
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    done = tables.stage(evolve(numbered(todo, ["path"], "id", top), FILES), "indexed")
    good = tables.upsert_files(evolve(old, FILES), done.where("error IS NULL"))
    return tables.upsert_errors(evolve(good, FILES), done.where("error IS NOT NULL").select("id", "path", "error", "indexed_at"))


def assign_duplicates(files: DataFrame, strategy: str = "prefer_exif_then_largest") -> DataFrame:
    good = files.where("error IS NULL").drop("dup_of")
    marked = mark_duplicates(good, "hash", "id", canonical_order(strategy, F.col("taken_at_source"), F.col("size")))
    return marked.unionByName(files.where("error IS NOT NULL"))


def pending_phash(files: DataFrame) -> DataFrame:
    """Photos without a perceptual hash: what a provider still has to hash."""
    return files.where("media_type = 'photo' AND phash IS NULL AND error IS NULL")
