"""Ogg media columns: bytes are stored losslessly as 8-bit PCM in Ogg and read back.

Container rules follow RFC 3533: pages with a CRC-32 (polynomial 0x04C11DB7, no reflection,
no inversion), packets cut by lacing values, several logical streams multiplexed by serial
number, and a granule position that counts the samples finished on a page. The reader checks
every page's checksum and sequence, puts packets together across pages, splits the streams and
derives a packet's end time from granule position and sample rate.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import id_text

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1
PCM_MAGIC = b"tmPCM8\0\0"
NOTE_MAGIC = b"tmNote\0\0"
SAMPLE_RATE = 8000
PACKET_SAMPLES = 4096
PAGE_LACES = 255
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes break a rule of the container."""


def page_crc(page: bytes) -> int:
    """The container's CRC of a page whose checksum field is zero.

    zlib has the mirrored form of the polynomial: mirror the bits of every byte, start at 0
    instead of all ones, undo the final inversion, mirror the result.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes([length % 255])


def _page(flags: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", CAPTURE, 0, flags, granule, serial, number, 0) + bytes([len(laces)]) + laces
    page = head + body
    return page[:22] + struct.pack("<I", page_crc(page)) + page[26:]


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; ``packets`` are (bytes, granule position at their end).

    The first packet has a page to itself, as the format asks of headers.
    """
    pages: list[bytes] = []
    laces, body, granule, carried = bytearray(), [], NO_PACKET_ENDS, False

    def flush(last: bool, open_packet: bool) -> None:
        nonlocal laces, body, granule, carried
        flags = CONTINUED * carried | FIRST * (not pages) | LAST * last
        pages.append(_page(flags, granule, serial, len(pages), bytes(laces), b"".join(body)))
        laces, body, granule, carried = bytearray(), [], NO_PACKET_ENDS, open_packet

    for k, (data, end) in enumerate(packets):
        rest, at = lacing(len(data)), 0
        while rest:
            part, rest = rest[: PAGE_LACES - len(laces)], rest[PAGE_LACES - len(laces) :]
            n = sum(part)
            laces += part
            body.append(data[at : at + n])
            at += n
            if not rest:
                granule = end
            if rest or (len(laces) == PAGE_LACES and k + 1 < len(packets)):
                flush(False, bool(rest))
        if k == 0 and laces and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return pages


def multiplex(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: all first pages, then the other pages in turn."""
    lists = [stream_pages(serial, packets) for serial, packets in streams.items()]
    out = [pages[0] for pages in lists]
    for k in range(1, max(map(len, lists))):
        out += [pages[k] for pages in lists if k < len(pages)]
    return b"".join(out)


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule position of the page a packet ends on
    on: list[int] = field(default_factory=list)  # that page's number
    open: list[bytes] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def demultiplex(data: bytes) -> dict[int, LogicalStream]:
    """The logical streams of a physical one; raises :class:`OggError` on any broken page."""
    found: dict[int, LogicalStream] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE or len(data) < at + 27:
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        laces = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(laces)
        if version or len(laces) < n or end > len(data):
            raise OggError(f"page at byte {at} is cut or of another version")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"page at byte {at} has a wrong checksum")
        if (serial not in found) != bool(flags & FIRST):
            raise OggError(f"page at byte {at} is out of its stream")
        s = found.setdefault(serial, LogicalStream(serial))
        if s.ended or number != s.pages or bool(flags & CONTINUED) != bool(s.open):
            raise OggError(f"page {number} of stream {serial} is out of order")
        s.pages += 1
        pos, run = at + 27 + n, 0
        for lace in laces:
            run += lace
            if lace < 255:
                s.packets.append(b"".join([*s.open, data[pos : pos + run]]))
                s.ends.append(granule)
                s.on.append(number)
                s.open, pos, run = [], pos + run, 0
        if run:
            s.open.append(data[pos : pos + run])
        elif laces and laces[-1] == 255:
            s.open.append(b"")
        s.ended = bool(flags & LAST)
        at = end
    if any(s.open or not s.ended for s in found.values()):
        raise OggError("a stream has no end")
    return found


def end_positions(s: LogicalStream, samples: Callable[[bytes], int] = len) -> list[int]:
    """Where each packet ends. A page gives the position of its last packet's end; those before it on the page
    end earlier by the samples of the packets between."""
    out = list(s.ends)
    for k in range(len(out) - 2, -1, -1):
        if s.on[k] == s.on[k + 1]:
            out[k] = out[k + 1] - samples(s.packets[k + 1])
    return out


def pcm_streams(payload: bytes, unpadded: int, rate: int = SAMPLE_RATE) -> dict[int, list[tuple[bytes, int]]]:
    """A stream of samples, headed by its format, beside a stream that notes the length without padding."""
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    audio = [(PCM_MAGIC + struct.pack("<IHH", rate, 8, 1), 0)]
    audio += [(payload[k : k + PACKET_SAMPLES], min(k + PACKET_SAMPLES, len(payload))) for k in range(0, len(payload), PACKET_SAMPLES)]
    return {serial: audio, serial | 1: [(NOTE_MAGIC, 0), (struct.pack("<Q", unpadded), len(payload))]}


def padded(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def store(text: str) -> bytes:
    data = text.encode("utf-8")
    return multiplex(pcm_streams(padded(data), len(data)))


@dataclass
class Samples:
    payload: bytes
    unpadded: int
    rate: int
    seconds: float
    timestamps: list[float]


def read(media: bytes) -> Samples:
    streams = demultiplex(media)
    audio = next((s for s in streams.values() if s.packets and s.packets[0].startswith(PCM_MAGIC)), None)
    note = next((s for s in streams.values() if s.packets and s.packets[0].startswith(NOTE_MAGIC)), None)
    if audio is None or note is None or len(note.packets) < 2:
        raise OggError("no samples")
    rate = struct.unpack_from("<I", audio.packets[0], 8)[0]
    payload = b"".join(audio.packets[1:])
    if audio.ends[-1] != len(payload):
        raise OggError("the last granule position is not the number of samples")
    return Samples(payload, struct.unpack("<Q", note.packets[1])[0], rate, len(payload) / rate, [g / rate for g in end_positions(audio)[1:]])


def feature(s: Samples) -> str:
    """Mean, root mean square about 128 and the rate of zero crossings, plus duration: exact integers first."""
    x = np.frombuffer(s.payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};ms={len(x) * 1000 // s.rate};last={s.timestamps[-1]:.6f}"


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media binary): every text as an Ogg file; null text as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([store(t.as_py()) for t in part.column(1)], pa.binary())], ["doc_id", "media"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def _parts(b: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Short slices, so that long rows do not add up in memory."""
    for k in range(0, b.num_rows, rows):
        yield b.slice(k, rows)


def media_features(media: DataFrame) -> DataFrame:
    """Read a media column back: lengths, digests and features, one row per row.

    Bytes that are no whole Ogg file of this form fail the job with :class:`OggError`; null
    media gives null results. Repeated rows stay repeated. Empty texts hold 64 zero samples.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 7
        s = read(m)
        return s.unpadded, len(s.payload), sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(m), sha256(m).hexdigest(), feature(s)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(m.as_py()) for m in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return media.select("doc_id", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
