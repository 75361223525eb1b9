"""Names for automatic events from a provider; manual names are never touched."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import span_name
from tidemark.operators.grouping import best_per_group
from tidemark.sources.tables import stage


@dataclass(frozen=True)
class Occasion:
    started_at: datetime
    ended_at: datetime
    place: str | None
    samples: tuple[str, ...]


#: A provider: a name for an occasion, or None to keep the one it has.
Namer = Callable[[Occasion], str | None]


def occasions(events: DataFrame, event_files: DataFrame, files: DataFrame, samples: int = 4) -> DataFrame:
    """Automatic events with the paths of their first ``samples`` files by time."""
    known = event_files.join(files.select(F.col("id").alias("file_id"), "path", "taken_at"), "file_id")
    first = best_per_group(known, ["event_id"], [F.asc("taken_at"), F.asc("file_id")], samples).groupBy(F.col("event_id").alias("id"))
    paths = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("samples"))
    return events.where("NOT name_is_manual").join(paths, "id", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def by_template(events: DataFrame) -> DataFrame:
    """(id, proposed): dates and place."""
    return events.where("NOT name_is_manual").select("id", span_name(F.col("started_at"), F.col("ended_at"), F.col("place_city")).alias("proposed"))


def by_provider(events: DataFrame, event_files: DataFrame, files: DataFrame, namer: Namer, samples: int = 4) -> DataFrame:
    """(id, proposed) from a model or a service, asked on the tasks; null where it fails or has no name."""

    def run(batches):
        import pandas as pd

        for b in batches:
            names: list[str | None] = []
            for r in b.itertuples():
                try:
                    names.append(namer(Occasion(r.started_at, r.ended_at, r.place_city, tuple(r.samples))))
                except Exception:  # noqa: BLE001  the event keeps its name
                    names.append(None)
            yield pd.DataFrame({"id": b["id"], "proposed": pd.Series(names, dtype=object)})

    asked = occasions(events, event_files, files, samples).select("id", "started_at", "ended_at", "place_city", "samples")
    return asked.mapInPandas(run, "id long, proposed string")


def name_events(events: DataFrame, proposed: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The events with the proposed names, and how many were renamed, unchanged, without proposal, and manual."""
    d = stage(events.join(proposed.groupBy("id").agg(F.max("proposed").alias("_new")), "id", "left"), "named-events")
    new, free = F.nullif(F.trim("_new"), F.lit("")), ~F.col("name_is_manual")
    n = lambda c: F.count(F.when(c, 1))
    stats = d.agg(
        n(free).alias("total"),
        n(free & new.isNull()).alias("failed"),
        n(free & (new == F.col("name"))).alias("unchanged"),
        n(free & new.isNotNull() & ~new.eqNullSafe(F.col("name"))).alias("renamed"),
        n(~free).alias("manual_kept"),
    )
    return d.withColumn("name", F.when(free, F.coalesce(new, F.col("name"))).otherwise(F.col("name"))).drop("_new"), stats.first().asDict()
