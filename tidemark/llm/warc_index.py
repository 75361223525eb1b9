"""WARC archives with an index first: write, index, then read selected records by byte range.

Writing gives one gzip member per record (so a record can be read alone) and, at the same time,
the index row of every record: file, offset, length, URL, digest. Reading sorts the selected
index rows by file and offset, joins ranges that lie close together into one read, and parses
each record from its own bytes. A task writes a file of a name of its own; the index only names
files of tasks that succeeded, so a lost executor or a second attempt leaves no trace in it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, partitions_for, shared_dir

#: A fixed date: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
_ID = "urn:x-page:"
_GAP, _READ = 64 << 10, 4 << 20
#: Bytes of archives that a task reads, about.
_TASK = 32 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def record(page_id: int, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """An uncompressed WARC/1.1 record: a resource with its payload, or a revisit without.

    A revisit's block is empty; the length of the payload it stands for is in an extension field.
    """
    sha1 = "sha1:" + base64.b32encode(digest).decode()
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_ID}{page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"]),
        f"WARC-Payload-Digest: {sha1}",
        f"X-Payload-Length: {len(payload)}",
    ]
    block = payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
        block = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:n]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def plan_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, html) plus ``refers_to``: the largest page_id of equal payloads of at least ``least`` bytes.

    Digests are aggregated before they are joined, and only digests of several pages are joined.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    many = (
        p.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "newest")
    )
    # Ids of copies are joined to their digests first, then to the payloads: copies of a large page do not meet in a task.
    older = p.select("page_id", "digest").join(many, "digest").where("page_id <> newest").groupBy("page_id", "digest").agg(F.max("newest").alias("newest"))
    return p.join(older, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", F.when(F.col("newest") != F.col("page_id"), F.col("newest")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records of :func:`plan_revisits` below ``folder``; returns the index, written too.

    Pages without id are no records and are left out. Repeated rows give repeated records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        name, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            rows = []
            for pid, url, payload, digest, ref in zip(*(b.column(k) for k in range(5)), strict=True):
                pid, url, payload, digest, ref = pid.as_py(), url.as_py(), payload.as_py(), digest.as_py(), ref.as_py()
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(open_fs(name)[1], compression=None)
                data = _gzip(record(pid, url, payload, digest, ref))
                out.write(data)
                rows.append((pid, url, name, at, len(data), digest.hex(), len(payload), "response" if ref is None else "revisit", ref))
                at += len(data)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    kept = records.where(F.col("page_id").isNotNull()).select("page_id", "url", "payload", "digest", "refers_to")
    return materialize(kept.mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = _GAP, most: int = _READ) -> list[tuple[int, int, int]]:
    """Join sorted (offset, length) into reads (offset, length, records), over gaps up to ``gap`` and up to ``most`` bytes unless one record is longer."""
    out: list[tuple[int, int, int]] = []
    for at, n in rows:
        if out and at - (out[-1][0] + out[-1][1]) <= gap and at + n - out[-1][0] <= most:
            first, _, count = out[-1]
            out[-1] = (first, at + n - first, count + 1)
        else:
            out.append((at, n, 1))
    return out


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` selects, each checked against its digest where it has a payload.

    Returns page_id, url, payload (null for revisits), payload_bytes, payload_digest,
    record_type, refers_to, all from the archives' bytes. Only file, offset, length are used.
    """
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def one(data: bytes) -> tuple:
        fields, block = parse(zlib.decompress(data, 31))
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
        kind, ref = fields["warc-type"], fields.get("warc-refers-to")
        size = int(fields["x-payload-length"])
        if kind == "response" and (hashlib.sha1(block).digest() != digest or len(block) != size):
            raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
        number = lambda s: int(s.strip("<>").removeprefix(_ID))
        return number(fields["warc-record-id"]), fields.get("warc-target-uri"), block if kind == "response" else None, size, digest.hex(), kind, number(ref) if ref else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            start = 0
            while start < len(rows):
                stop = start
                while stop < len(rows) and rows[stop][0] == rows[start][0]:
                    stop += 1
                if rows[start][0] != name:
                    if opened is not None:
                        opened.close()
                    name = rows[start][0]
                    opened = open_fs(name)[0].open_input_file(open_fs(name)[1])
                k = start
                for at, n, count in ranges([r[1:] for r in rows[start:stop]]):
                    opened.seek(at)
                    chunk = opened.read(n)
                    got = [one(chunk[o - at : o - at + m]) for _, o, m in rows[k : k + count]]
                    k += count
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds.values(), strict=True)], list(kinds))
                start = stop
        if opened is not None:
            opened.close()

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    chosen = index.select("file", "offset", "length")
    total = chosen.agg(F.sum("length")).first()[0] or 0
    # As many ranges of places as the archives' bytes ask for: the index's own bytes say little about them.
    parts = max(partitions_for(index), -(-total // _TASK))
    return chosen.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write all pages as archives in the shared folder and read every record back."""
    index = write_archives(plan_revisits(pages, least), shared_dir(pages.sparkSession, "warc"))
    return read_records(index)
