"""Pictures on the tasks: decoding, turning, perceptual hashes, thumbnails, and camera records read by Pillow.

Pillow is imported where a function needs it; decoders and readers are parameters, so that another
library, or a table of stored arrays, can take its place.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Quarter turns against the clock that set a picture upright, by its orientation tag (fixed values); mirrored ones stay.
TURNS = {3: 2, 6: 3, 8: 1}
#: Tags of camera records (fixed values).
TAG_TAKEN, TAG_DATE, TAG_MAKE, TAG_MODEL, TAG_ORIENTATION, TAG_GPS, TAG_EXIF = 36867, 306, 271, 272, 274, 34853, 34665

Decoder = Callable[[str, int, bool], np.ndarray]


def upright(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    turns = TURNS.get(orientation or 0, 0)
    return np.ascontiguousarray(np.rot90(pixels, turns)) if turns else pixels


def pillow_pixels(path: str, max_edge: int, gray: bool) -> np.ndarray:
    """A picture's pixels, no edge longer than ``max_edge``; JPEG files are scaled down as they are read."""
    from PIL import Image

    with Image.open(path) as img:
        mode = "L" if gray else "RGB"
        img.draft(mode, (max_edge, max_edge))
        img = img.convert(mode)
        img.thumbnail((max_edge, max_edge))
        return np.asarray(img)


def orientation_of(path: str) -> int | None:
    from PIL import Image

    with Image.open(path) as img:
        return img.getexif().get(TAG_ORIENTATION)


class Pictures:
    """Decoded pictures, the last ``most`` of them kept, by path, time of change and form; failures are not kept.

    One of these lives in a Python worker, so a task that looks at a picture for several models decodes it once.
    """

    def __init__(self, decode: Decoder = pillow_pixels, turn: Callable[[str], int | None] | None = None, most: int = 512):
        self._decode, self._turn, self._most = decode, turn, most
        self._kept: OrderedDict[tuple, np.ndarray] = OrderedDict()

    def get(self, path: str, max_edge: int = 1280, gray: bool = False) -> np.ndarray | None:
        """Pixels, upright if ``turn`` tells orientations; None if the file can't be decoded."""
        try:
            key = (path, os.stat(path).st_mtime_ns if os.path.exists(path) else None, max_edge, gray)
            if key in self._kept:
                self._kept.move_to_end(key)
                return self._kept[key]
            pixels = upright(self._decode(path, max_edge, gray), self._turn(path) if self._turn else None)
        except Exception:  # noqa: BLE001  any decoder's error costs its picture, not the job
            return None
        self._kept[key] = pixels
        if len(self._kept) > self._most:
            self._kept.popitem(last=False)
        return pixels

    def clear(self) -> None:
        self._kept.clear()


def shrink(pixels: np.ndarray, side: int) -> np.ndarray:
    """Mean over a grid of ``side`` x ``side`` cells."""
    rows, cols = (np.linspace(0, n, side + 1) for n in pixels.shape[:2])
    out = np.empty((side, side))
    for i in range(side):
        for j in range(side):
            y, x = int(rows[i]), int(cols[j])
            out[i, j] = pixels[y : max(y + 1, int(rows[i + 1])), x : max(x + 1, int(cols[j + 1]))].mean()
    return out


def perceptual_hash(gray: np.ndarray, side: int = 8, detail: int = 4) -> str:
    """Signs of the low frequencies of a cosine transform against their median, as ``side`` * ``side`` bits in hexadecimal."""
    n = side * detail
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ shrink(gray.astype(float), n) @ basis.T)[:side, :side]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{side * side // 4}x}"


def with_phashes(pending: DataFrame, decode: Decoder = pillow_pixels) -> DataFrame:
    """(id, phash) of ``pending`` (id, path); null where a picture can't be decoded. Tasks look at their pictures one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pictures = Pictures(decode, most=1)
        for b in batches:
            found = [pictures.get(p, 128, True) for p in b["path"]]
            yield pd.DataFrame({"id": b["id"], "phash": [None if x is None or not x.size else perceptual_hash(x) for x in found]})

    return pending.select("id", "path").mapInPandas(run, "id long, phash string")


def thumbnails(files: DataFrame, folder: str, edge: int = 256, decode: Decoder = pillow_pixels, save: Callable[[np.ndarray, str], None] | None = None) -> DataFrame:
    """(id, thumbnail): small pictures written below ``folder``, which all tasks share; null where one can't be made."""

    def by_pillow(pixels: np.ndarray, path: str) -> None:
        from PIL import Image

        Image.fromarray(pixels).save(path, "JPEG", quality=80)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        pictures = Pictures(decode, most=1)
        for b in batches:
            out: list[str | None] = []
            for i, p in zip(b["id"], b["path"], strict=True):
                pixels, target = pictures.get(p, edge), f"{folder}/{i}.jpg"
                try:
                    if pixels is None:
                        raise OSError(p)
                    (save or by_pillow)(pixels, target)
                    out.append(target)
                except Exception:  # noqa: BLE001  a file without preview
                    out.append(None)
            yield pd.DataFrame({"id": b["id"], "thumbnail": out})

    return files.select("id", "path").mapInPandas(run, "id long, thumbnail string")


def _angle(parts: Any, ref: Any) -> float | None:
    try:
        d, m, s = (float(x) for x in parts)
    except (TypeError, ValueError, ZeroDivisionError):
        return None
    size = d + m / 60 + s / 3600
    return -size if str(ref or "").upper()[:1] in ("S", "W") else size


def pillow_records(paths: list[str]) -> list[dict[str, Any]]:
    """Camera records by Pillow, a reader for ``files.read_with``: what a file lacks is left out."""
    from PIL import Image

    out = []
    for path in paths:
        with Image.open(path) as img:
            tags = img.getexif()
            own, gps = tags.get_ifd(TAG_EXIF), tags.get_ifd(TAG_GPS)
            found = {
                "date_original": own.get(TAG_TAKEN) or tags.get(TAG_DATE), "camera_make": tags.get(TAG_MAKE), "camera_model": tags.get(TAG_MODEL), "orientation": tags.get(TAG_ORIENTATION),
                "gps_lat": _angle(gps.get(2), gps.get(1)), "gps_lon": _angle(gps.get(4), gps.get(3)), "width": img.width, "height": img.height,
            }
            out.append({k: v for k, v in found.items() if v not in (None, "")})
    return out


class Features:
    """Features of pictures, encoded once for all questions that are asked of them: a table (file_id, features) and scores on it."""

    def __init__(self, encode: Callable[[list[str]], list[list[float] | None]], width: int):
        self.encode, self.width = encode, width

    def table(self, files: DataFrame, size: int = 64) -> DataFrame:
        """(file_id, features); a picture that can't be read has zeros."""
        encode, width = self.encode, self.width

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got: list[list[float] | None] = []
                for k in range(0, len(b), size):
                    got += encode(b["path"].iloc[k : k + size].tolist())
                yield pd.DataFrame({"file_id": b["id"], "features": [[0.0] * width if x is None else [float(v) for v in x] for x in got]})

        return files.select("id", "path").mapInPandas(run, "file_id long, features array<double>")
