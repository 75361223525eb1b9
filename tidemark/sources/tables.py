"""Tables on disk: staged results, upserts by key, guarded updates. Plain Parquet has no MERGE,
so a new version is written beside the old one and takes its place when it is whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the one that driver and executors share; only a local master may leave that unset."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: lineage ends there, and so do its shuffle files."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables; nothing may read them afterwards."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            fs, path = _fs(t.sparkSession, folder)
            fs.delete(path, True)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace(df: DataFrame, path: str) -> None:
    """Overwrite the table at ``path``, which ``df`` may read: write beside, then swap."""
    spark = df.sparkSession
    new, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.parquet(new)
    fs, target = _fs(spark, path)
    if fs.exists(target):
        fs.rename(target, _fs(spark, old)[1])
    fs.rename(_fs(spark, new)[1], target)
    fs.delete(_fs(spark, old)[1], True)


def reset(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """``new`` rows replace ``old`` rows of equal key; ``keep`` computes columns from both (``old.x``, ``new.x``)."""
    untouched = old.join(new.select(*key), key, "left_anti")
    if not keep:
        return untouched.unionByName(new, allowMissingColumns=True)
    o, n = old.alias("old"), new.alias("new")
    match = None
    for k in key:
        c = F.col(f"new.{k}") == F.col(f"old.{k}")
        match = c if match is None else match & c
    merged = n.join(o, match, "left").select(*[keep[c].alias(c) if c in keep else F.col(f"new.{c}").alias(c) for c in new.columns])
    return untouched.unionByName(merged, allowMissingColumns=True)


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows by path: duplicates and errors start anew, a perceptual hash stays while the content does."""
    same = F.col("old.hash").eqNullSafe(F.col("new.hash")) & F.col("old.path").isNotNull()
    keep = {
        "phash": F.when(same, F.coalesce("old.phash", "new.phash")).otherwise(F.col("new.phash")),
        "dup_of": F.lit(None).cast("long"),
        "error": F.lit(None).cast("string"),
        "id": F.coalesce("old.id", "new.id"),
    }
    return upsert(old, new, ["path"], keep)


def upsert_errors(old: DataFrame, failed: DataFrame) -> DataFrame:
    """``failed`` (id, path, error, indexed_at): known paths get the error, new ones a row of type photo."""
    e = failed.select(F.col("path"), F.col("error").alias("_e"), F.col("indexed_at").alias("_at"))
    known = old.join(e, "path", "left").withColumn("error", F.coalesce("_e", "error")).withColumn("indexed_at", F.coalesce("_at", "indexed_at")).drop("_e", "_at")
    fresh = failed.join(old.select("path"), "path", "left_anti").withColumn("media_type", F.lit("photo"))
    return known.unionByName(fresh, allowMissingColumns=True)


def guarded_update(df: DataFrame, guard: Column, values: dict[str, Column]) -> DataFrame:
    """Only rows for which ``guard`` is true change."""
    sure = F.coalesce(guard, F.lit(False))
    return df.select(*[F.when(sure, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def changes(old: DataFrame, seen: DataFrame) -> DataFrame:
    """``seen`` (path, size, mtime) with ``action``: add, skip (same size, mtime within a microsecond) or update."""
    o = old.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_known"))
    same = F.col("size").eqNullSafe(F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) < 1e-6)
    action = F.when(F.col("_known").isNull(), "add").when(F.coalesce(same, F.lit(False)), "skip").otherwise("update")
    return seen.join(o, "path", "left").withColumn("action", action).drop("_size", "_mtime", "_known")
