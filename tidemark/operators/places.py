"""Places of files: by position, then from the nearest file of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import coordinate
from tidemark.functions.scores import argmax, softmax
from tidemark.operators import sessions
from tidemark.operators.nearest import resolve
from tidemark.schema import canonical


def resolve_places(files: DataFrame, places: DataFrame, gap_hours: float = 6) -> DataFrame:
    """(file_id, country, city_geonameid, district_geonameid, confidence) of all canonical files.

    Files with a position are ``exact_gps``, whatever it resolves to. Dated files of a session
    without one take over the nearest such file's place (``session_inferred``), unless their date
    is a guess; guessed dates can be sources. The rest is ``unknown``.
    """
    f = canonical(files).select("id", "taken_at", "taken_at_confidence", coordinate(F.col("gps_lat")).alias("lat"), coordinate(F.col("gps_lon")).alias("lon"))
    found = resolve(f, places)
    f = f.join(found, ["lat", "lon"], "left").withColumn("exact", F.col("lat").isNotNull() & F.col("lon").isNotNull())
    dated = sessions.overall(f.where(F.col("taken_at").isNotNull()), "taken_at", ["id"], gap_hours * 3600)
    target = F.col("taken_at_confidence").isin("high", "medium")
    got = sessions.inherit_nearest(dated, ["session"], "taken_at", "id", F.col("exact"), target, ["country", "city_geonameid", "district_geonameid"])
    undated = f.where(F.col("taken_at").isNull()).withColumn("inherited", F.lit(None).cast(got.schema["inherited"].dataType))
    both = got.drop("session").unionByName(undated)
    pick = lambda c: F.when(F.col("exact"), F.col(c)).otherwise(F.col(f"inherited.{c}")).alias(c)
    confidence = F.when(F.col("exact"), "exact_gps").when(F.col("inherited").isNotNull(), "session_inferred").otherwise("unknown")
    return both.select(F.col("id").alias("file_id"), pick("country"), pick("city_geonameid"), pick("district_geonameid"), confidence.alias("confidence"))


def landmarks(places: DataFrame, logits: DataFrame, prompts: list[tuple[str, str]], threshold: float = 0.85) -> DataFrame:
    """Unknown places whose best landmark is sure enough get its country and city, as ``visual``.

    ``logits`` (file_id, logits): landmark prompts first, then negatives; the softmax is over all,
    the best is sought among landmarks. ``prompts``: (country, city) per landmark.
    """
    p = F.slice(softmax(F.col("logits")), 1, len(prompts))
    scored = logits.select("file_id", F.array_max(p).alias("_p"), argmax(p).alias("_k"))
    country, city = (F.array(*[F.lit(x[k]) for x in prompts]) for k in (0, 1))
    d = places.join(scored, "file_id", "left")
    hit = F.coalesce((F.col("confidence") == "unknown") & (F.col("_p") >= threshold), F.lit(False))
    d = d.withColumn("country", F.when(hit, F.get(country, F.col("_k"))).otherwise(F.col("country"))).withColumn("_hit", hit)
    if "city" not in d.columns:
        d = d.withColumn("city", F.lit(None).cast("string"))
    return d.withColumn("city", F.when(F.col("_hit"), F.get(city, F.col("_k"))).otherwise(F.col("city"))).withColumn("confidence", F.when(F.col("_hit"), "visual").otherwise(F.col("confidence"))).drop("_p", "_k", "_hit")


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
