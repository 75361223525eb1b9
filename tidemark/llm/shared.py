"""Helpers that several corpus operators use: shared folders, cut lineage, text as bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local master may leave it
    unset (tests, one machine): a temporary folder is made once and used by the whole session.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a batch that goes to a Python worker: texts are long, and the JVM and the worker hold a batch each.
_ROWS, _BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextlib.contextmanager
def written(spark: SparkSession) -> Iterator[None]:
    """For statements whose result is written: shuffle files are deleted as they end, not when the driver collects
    garbage, and batches for Python workers are short."""
    before = {k: spark.conf.get(k) for k in (_CLEAN, _ROWS)}
    rows = int(before[_ROWS])
    spark.conf.set(_CLEAN, "true")
    spark.conf.set(_ROWS, str(min(rows, _BATCH) if rows > 0 else _BATCH))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage, shuffle files and large batches end there."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    with written(spark):
        df.write.parquet(path)
    gc.collect()  # plans that Python holds on to are held in the JVM as well
    return spark.read.schema(df.schema).parquet(path)


_worker: dict = {"operator": None, "forget": []}


def forget_with(clear: Callable[[], None]) -> None:
    """Have ``clear`` called in a Python worker that turns to another operator."""
    _worker["forget"].append(clear)


def leave() -> None:
    """To be called as a task ends: a Python worker that waits for another one should hold little memory beside the JVM's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def enter(operator: str) -> None:
    """To be called as a task of ``operator`` begins: what other operators left in this worker goes back to the system.

    Workers outlive tasks, and a pipeline's stages would otherwise add up their memories.
    """
    if _worker["operator"] not in (None, operator):
        for clear in _worker["forget"]:
            clear()
        leave()
    _worker["operator"] = operator


def drop_table(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`materialize`; nothing may read them afterwards."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """The session's shuffle partitions, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, null text as empty; other columns of any name are dropped."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
