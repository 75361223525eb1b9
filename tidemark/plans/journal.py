"""Applying a plan: a ledger of moves written ahead, transfers that never overwrite, and undo.

Files are moved by the driver; the ledger is a table of status events, of which a move's latest counts.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import MOVES
from tidemark.sources.files import content_hash
from tidemark.sources.tables import stage


@dataclass
class Report:
    done: int = 0
    failed: int = 0
    skipped: int = 0
    deleted: int = 0
    missing: int = 0


class Ledger:
    """Status events below ``path``; each append is a Parquet file of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._seq = spark, path, None

    def append(self, rows: list[tuple]) -> None:
        if not rows:
            return
        if self._seq is None:
            self._seq = self.events().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        out = []
        for r in rows:
            self._seq += 1
            out.append((self._seq, *r))
        self.spark.createDataFrame(out, MOVES).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(MOVES).parquet(self.path)
        except Exception as e:  # an empty ledger has no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MOVES)

    def latest(self) -> DataFrame:
        """One row per move with its last status."""
        return self.events().groupBy("batch_id", "id").agg(F.max_by(F.struct("file_id", "src", "dst", "hash", "status"), "seq").alias("m")).select("batch_id", "id", "m.*")

    def last_batch(self) -> int | None:
        """The highest batch with a move that is done."""
        return self.latest().where("status = 'done'").agg(F.max("batch_id")).first()[0]

    def payload(self, batch_id: int, root: str) -> DataFrame:
        from tidemark.functions.text import relative_to

        return self.latest().where(F.col("batch_id") == batch_id).withColumn("target_rel", relative_to(F.col("dst"), root)).orderBy("dst")


def transfer(src: str, dst: str, operation: str = "move") -> None:
    """Move, copy or link; never over an existing file. Copies are checked by size; a link that cannot be made is a copy."""
    if os.path.lexists(dst):
        raise FileExistsError(dst)
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    if operation == "link":
        try:
            os.link(src, dst)
            return
        except OSError:
            operation = "copy"
    if operation == "move":
        try:
            os.rename(src, dst)
            return
        except OSError:
            pass
    shutil.copy2(src, dst)
    if os.path.getsize(src) != os.path.getsize(dst):
        os.unlink(dst)
        raise OSError(f"{dst}: the copy is not whole")
    if operation == "move":
        os.unlink(src)


def apply(ledger: Ledger, batch_id: int, plan: Iterable[tuple], operation: str = "move", chunk: int = 5_000) -> Report:
    """``plan``: (file_id, src, dst, hash) or, with a fifth field that is true, a file to delete.

    Moves are taken ``chunk`` by chunk, so a plan may be read from the cluster as it is carried out; every
    move of a chunk is in the ledger as planned before its first file is touched. A file whose content is
    not the indexed one any more fails; one already in place is passed over.
    """
    report, rows, number = Report(), iter(plan), 0
    while part := list(islice(rows, chunk)):
        todo = []
        for f, s, d, h, *delete in part:
            if s == d and not any(delete):
                report.skipped += 1
                continue
            number += 1
            todo.append((number, f, s, d, h, any(delete)))
        ledger.append([(k, batch_id, f, s, d, h, "planned") for k, f, s, d, h, _ in todo])
        after = []
        for k, f, s, d, h, delete in todo:
            try:
                if h is not None and content_hash(s) != h:
                    raise OSError(f"{s} has changed")
                if delete:
                    os.unlink(s)
                    report.deleted += 1
                else:
                    transfer(s, d, operation)
                    report.done += 1
                after.append((k, batch_id, f, s, d, h, "deleted" if delete else "done"))
            except OSError:
                report.failed += 1
                after.append((k, batch_id, f, s, d, h, "failed"))
        ledger.append(after)
    return report


def free_name(path: str) -> str:
    stem, ext = os.path.splitext(path)
    n, cand = 0, path
    while os.path.lexists(cand):
        n += 1
        cand = f"{stem}_{n}{ext}"
    return cand


def undo(ledger: Ledger, batch_id: int | None = None, operation: str = "move", chunk: int = 5_000) -> Report:
    """Take back the last batch with done moves, newest move first, read from the cluster as they are taken back. A copy
    goes only if it is still what was copied; a file that is gone stays done and counts as missing."""
    batch_id = batch_id if batch_id is not None else ledger.last_batch()
    report, after = Report(), []
    if batch_id is None:
        return report
    done = stage(ledger.latest().where((F.col("batch_id") == batch_id) & (F.col("status") == "done")), "undo")  # the ledger grows meanwhile
    for r in done.orderBy(F.desc("id")).toLocalIterator():
        if not os.path.lexists(r.dst):
            report.missing += 1
            continue
        try:
            if operation == "move":
                transfer(r.dst, free_name(r.src), "move")
            elif r.hash is None or content_hash(r.dst) == r.hash:
                os.unlink(r.dst)
            else:
                report.failed += 1
                continue
            report.done += 1
            after.append((r.id, batch_id, r.file_id, r.src, r.dst, r.hash, "undone"))
        except OSError:
            report.failed += 1
        if len(after) >= chunk:
            ledger.append(after)
            after = []
    ledger.append(after)
    return report
