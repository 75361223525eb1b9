"""Gap sessions, and inheritance of attributes from the nearest source within a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, ts: str, key: list[str], order: list[str], gap_seconds: float, out: str = "session") -> DataFrame:
    """``out``: the session's number within its key, from 1; a gap longer than ``gap_seconds`` starts a new one."""
    w = Window.partitionBy(*key).orderBy(ts, *order)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    starts = F.when(seconds > int(gap_seconds * 1_000_000), 1).when(F.lag(ts).over(w).isNull(), 1).otherwise(0)
    return df.withColumn("_new", starts).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def overall(df: DataFrame, ts: str, order: list[str], gap_seconds: float, out: str = "session") -> DataFrame:
    """Sessions over all rows without one big partition: sessions by day, corrected by a summary of the days.

    Within a day the gaps are local. A row per day (last time before it, sessions so far) tells
    whether a day's first row continues the day before, and where its numbers start.
    """
    gap = int(gap_seconds * 1_000_000)
    d = df.withColumn("_day", F.to_date(ts)).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    w = Window.partitionBy("_day").orderBy("_us", *order)
    d = d.withColumn("_new", (F.coalesce(F.col("_us") - F.lag("_us").over(w), F.lit(0)) > gap).cast("long"))
    d = d.withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = d.groupBy("_day").agg(F.min("_us").alias("lo"), F.max("_us").alias("hi"), F.sum("_new").alias("n"))
    line = Window.orderBy("_day")  # one row per day
    starts = F.when(F.col("lo") - F.lag("hi").over(line) <= gap, 0).otherwise(1)
    days = days.withColumn("s", starts).withColumn("base", F.sum(F.col("s") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    return d.join(days.select("_day", "base"), "_day").withColumn(out, (F.col("_local") + F.col("base")).cast("long")).drop("_day", "_us", "_new", "_local", "base")


def summary(df: DataFrame, keys: list[str], ts: str, least: int = 1) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n")).where(F.col("n") >= least)


def inherit_nearest(df: DataFrame, keys: list[str], ts: str, order: str, source: Column, target: Column, payload: list[str]) -> DataFrame:
    """``inherited``: the payload of the nearest source row of the session, for target rows that are no source.

    Nearest in time in both directions; at equal distance the earlier by (time, ``order``) wins. Of
    sources at one time, only the first counts.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    struct = F.struct(us.alias("us"), F.col(order).alias("ord"), *payload)
    w = Window.partitionBy(*keys).orderBy(ts, order)
    d = df.withColumn("_src", F.when(source, struct))
    same = Window.partitionBy(*keys, ts)
    d = d.withColumn("_first", F.min("_src").over(same))
    d = d.withColumn("_src", F.when(source & (F.col("_src.ord") == F.col("_first.ord")), F.col("_src"))).drop("_first")
    before = F.last("_src", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_src", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("_b", before).withColumn("_a", after)
    take_before = F.col("_a").isNull() | (F.abs(us - F.col("_b.us")) <= F.abs(F.col("_a.us") - us))
    near = F.when(F.col("_b").isNotNull() & take_before, F.col("_b")).otherwise(F.col("_a"))
    return d.withColumn("inherited", F.when(target & ~F.coalesce(source, F.lit(False)), near)).drop("_src", "_b", "_a")
