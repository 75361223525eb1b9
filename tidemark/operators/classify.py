"""Verdicts on files from names, camera fields and model scores: an ordered cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Naming
from tidemark.functions.scores import argmax, best_of
from tidemark.functions.text import basename, in_screenshot_folder, is_screenshot_name

#: Positions: three classes of pictures, five foils before documents, two before products (fixed values).
CLASSES = ("photo", "screenshot", "meme")
DOCUMENT_FROM, PRODUCT_FROM = 5, 2


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def heuristic(d: DataFrame) -> Column:
    """Screenshot by name, for files without camera fields; else null."""
    return F.when(~_given(F.col("camera_make")) & ~_given(F.col("camera_model")) & is_screenshot_name(basename(F.col("path"))), "screenshot")


def classify(d: DataFrame, cfg: Naming | None = None) -> DataFrame:
    """``verdict``, ``source``, ``score``, ``doc_score``, ``prod_score``, ``candidate`` of files with provider columns.

    Needs path, camera_make, camera_model, gps_lat, has_faces, probs[3], doc_probs[9], prod_probs[5],
    text_frac (null: not measured), vlm_label (null: not asked or failed).
    """
    cfg = cfg or Naming()
    doc = F.coalesce(best_of(F.col("doc_probs"), DOCUMENT_FROM), F.lit(0.0))
    prod = F.coalesce(best_of(F.col("prod_probs"), PRODUCT_FROM), F.lit(0.0))
    top, best = F.array_max("probs"), argmax(F.col("probs"))
    named = heuristic(d)
    real = _given(F.col("camera_make")) | _given(F.col("camera_model")) | F.col("gps_lat").isNotNull() | F.col("has_faces")
    label = F.get(F.array(*[F.lit(c) for c in CLASSES]), best)
    row = lambda v, s, x: F.struct(v.alias("v"), s.alias("s"), x.cast("double").alias("x"))
    lit = F.lit
    tier = (
        F.when(named.isNotNull(), row(lit("screenshot"), lit("heuristic"), lit(None)))
        .when(~F.col("has_faces") & (doc >= cfg.document_threshold), row(lit("document"), lit("clip"), doc))
        .when(real, row(lit("photo"), lit("clip"), lit(None)))
        .when(top >= cfg.junk_threshold, row(label, lit("clip"), top))
        .otherwise(row(lit("photo"), lit("clip"), top))
    )
    d = d.withColumn("doc_score", doc).withColumn("prod_score", prod).withColumn("_t", tier)
    v, frac = F.col("_t.v"), F.col("text_frac")
    looked = ~F.col("has_faces") & frac.isNotNull() & ((v == "document") | ((v == "photo") & (F.col("doc_score") >= cfg.text_rescue_docscore_min)))
    d = d.withColumn(
        "_t",
        F.when(looked & (v == "document") & (frac < cfg.text_frac_min), row(lit("photo"), lit("ocr"), frac))
        .when(looked & (v == "photo") & (frac >= cfg.text_frac_document), row(lit("document"), lit("ocr"), frac))
        .otherwise(F.col("_t")),
    )
    d = d.withColumn("_t", F.when((F.col("_t.v") == "photo") & in_screenshot_folder(F.col("path")), row(lit("screenshot"), lit("heuristic"), lit(None))).otherwise(F.col("_t")))
    v = F.col("_t.v")
    candidate = ~F.col("has_faces") & ~v.isin("screenshot", "meme") & ((v == "document") | (F.col("doc_score") >= cfg.text_rescue_docscore_min) | (F.col("prod_score") >= cfg.product_candidate_min))
    d = d.withColumn("candidate", candidate).withColumn("_t", F.when(F.col("candidate") & F.col("vlm_label").isNotNull(), row(F.col("vlm_label"), lit("vlm"), lit(None))).otherwise(F.col("_t")))
    return d.withColumn("verdict", F.col("_t.v")).withColumn("source", F.col("_t.s")).withColumn("score", F.col("_t.x")).drop("_t")


def heuristics_only(d: DataFrame) -> DataFrame:
    """Verdicts without any model: screenshots by name or folder, else photo."""
    v = F.coalesce(heuristic(d), F.when(in_screenshot_folder(F.col("path")), "screenshot"), F.lit("photo"))
    return d.withColumn("verdict", v).withColumn("source", F.lit("heuristic")).withColumn("score", F.lit(None).cast("double"))


def pending(files: DataFrame, known: DataFrame, tier: str) -> DataFrame:
    """Files that the active tier has not judged; an unknown tier counts as not judged."""
    done = known.where(F.col("tier").eqNullSafe(tier)).select(F.col("file_id").alias("id"))
    return files.join(done, "id", "left_anti")


def detected_faces(hits: DataFrame, threshold: float = 0.7, least_px: float = 40) -> DataFrame:
    """Detections good and large enough; files without any get a marker row with an empty box. ``hits``: (file_id, bbox, score, embedding)."""
    side = F.least(F.col("bbox")[2] - F.col("bbox")[0], F.col("bbox")[3] - F.col("bbox")[1])
    good = hits.where((F.size("bbox") == 4) & (F.col("score") >= threshold) & (side >= least_px)).select("file_id", F.transform("bbox", lambda x: F.round(x, 1)).alias("bbox"), "embedding")
    none = hits.select("file_id").distinct().join(good.select("file_id"), "file_id", "left_anti")
    return good.unionByName(none.select("file_id", F.array().cast("array<double>").alias("bbox"), F.lit(None).cast("array<float>").alias("embedding")))
