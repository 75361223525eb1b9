"""Streams, an extension: sessions and windows of a stream of events, duplicates within a watermark, upserts.

The batch operators have no streams; these give the same sessions as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import tables

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, schema: str = EVENTS, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def sessions(stream: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Gap sessions by key; a row exactly one gap after the last belongs to the session."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return grouped.agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n")).drop("w")


def windowed(stream: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "1 day", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def once(stream: DataFrame, ts: str = "ts", key: tuple[str, ...] = ("event_id",), late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def upsert_into(stream: DataFrame, path: str, key: list[str], schema: str, checkpoint: str) -> StreamingQuery:
    """Each batch's rows replace the table's rows of equal key; of rows with one key in a batch any one stays."""
    spark = stream.sparkSession

    def batch(df: DataFrame, _: int) -> None:
        new = df.dropDuplicates(key)
        try:
            old = spark.read.schema(schema).parquet(path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = spark.createDataFrame([], schema)
        tables.replace(tables.upsert(old, new, key), path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
