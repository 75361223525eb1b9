"""Ordered merging of sessions into trips: a fold, as each decision depends on the open group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(sessions: DataFrame, key: list[str], gap_seconds: float, anchor: list[str], same: Callable[[Column, Column], Column], out: str = "trip") -> DataFrame:
    """``sessions`` (started_at, ended_at, session, anchor columns) with the number of their trip within ``key``.

    A session joins the open trip if it starts less than ``gap_seconds`` after the trip's end and
    ``same(anchor of the trip's first session, own anchor)`` holds. Runs are cut at long gaps
    first, so a fold only sees sessions that could join.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = int(gap_seconds * 1_000_000)
    w = Window.partitionBy(*key).orderBy("started_at", "session")
    ended = F.max(us("ended_at")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = sessions.withColumn("_cut", F.coalesce(us("started_at") - ended >= gap, F.lit(True)).cast("int")).withColumn("_run", F.sum("_cut").over(w))
    item = F.struct(us("started_at").alias("s"), F.col("session"), us("ended_at").alias("e"), F.struct(*anchor).alias("a"))
    runs = d.groupBy(*key, "_run").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    first = F.get(F.col("_items"), F.lit(0))
    state = F.struct(first["e"].alias("end"), first["a"].alias("anchor"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        joins = (x["s"] - acc["end"] < gap) & F.coalesce(same(acc["anchor"], x["a"]), F.lit(False))
        no = F.when(F.size(acc["out"]) == 0, acc["no"]).when(joins, acc["no"]).otherwise(acc["no"] + 1)
        fresh = ~joins & (F.size(acc["out"]) > 0)
        return F.struct(
            F.when(fresh, x["e"]).otherwise(F.greatest(acc["end"], x["e"])).alias("end"),
            F.when(fresh, x["a"]).otherwise(acc["anchor"]).alias("anchor"),
            no.cast("int").alias("no"),
            F.concat(acc["out"], F.array(no.cast("int"))).alias("out"),
        )

    runs = runs.withColumn("_no", F.aggregate("_items", state, step)["out"])
    flat = runs.select(*key, "_run", F.explode(F.arrays_zip("_items", "_no")).alias("z")).select(*key, "_run", F.col("z._items.session").alias("session"), F.col("z._no").alias("_no"))
    number = F.dense_rank().over(Window.partitionBy(*key).orderBy("_run", "_no"))
    return sessions.join(flat.withColumn(out, number).drop("_run", "_no"), [*key, "session"])
