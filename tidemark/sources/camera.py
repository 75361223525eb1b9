"""Camera records from an external reader: one process that stays open per task, or one per list of files; and the choice of reader."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable, Sequence
from typing import Any

#: What is asked of the reader (fixed names), and the program.
TAGS = ("DateTimeOriginal", "CreateDate", "GPSLatitude", "GPSLongitude", "Make", "Model", "ImageWidth", "ImageHeight", "Orientation")
PROGRAM = "exiftool"
Reader = Callable[[list[str]], list[dict[str, Any]]]


def arguments() -> list[str]:
    return ["-json", "-n", *(f"-{t}" for t in TAGS)]


def in_order(paths: Sequence[str], records: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """A record per path, empty where the reader gave none."""
    known = {r.get("SourceFile"): r for r in records}
    return [known.get(p, {}) for p in paths]


class OpenReader:
    """A reader process that is asked again and again: arguments by its input, a line that says so ends each answer."""

    def __init__(self, command: Sequence[str] = (PROGRAM, "-stay_open", "True", "-@", "-")):
        self.command, self._process, self._asked = list(command), None, 0

    def _start(self) -> subprocess.Popen:
        if self._process is None or self._process.poll() is not None:
            self._process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, encoding="utf-8")
        return self._process

    def read(self, paths: list[str]) -> list[dict[str, Any]]:
        """The records of ``paths``; OSError if the process ended, and the next call starts another."""
        p = self._start()
        self._asked += 1
        end = f"{{ready{self._asked}}}"
        assert p.stdin is not None and p.stdout is not None
        p.stdin.write("\n".join([*arguments(), *paths, f"-execute{self._asked}"]) + "\n")
        p.stdin.flush()
        lines = []
        for line in p.stdout:
            if line.strip() == end:
                return in_order(paths, json.loads("".join(lines) or "[]"))
            lines.append(line)
        self.close()
        raise OSError("the reader ended")

    def close(self) -> None:
        if self._process is not None:
            self._process.kill()
            self._process.wait()
            self._process = None


def read_once(paths: list[str], command: Sequence[str] = (PROGRAM,), size: int = 200) -> list[dict[str, Any]]:
    """One process for each ``size`` files."""
    out: list[dict[str, Any]] = []
    for k in range(0, len(paths), size):
        part = paths[k : k + size]
        done = subprocess.run([*command, *arguments(), *part], capture_output=True, text=True, encoding="utf-8", check=False)
        out += in_order(part, json.loads(done.stdout or "[]"))
    return out


def first_that_works(readers: Sequence[Reader]) -> Reader:
    """A reader that asks each of ``readers`` in turn until one answers."""

    def read(paths: list[str]) -> list[dict[str, Any]]:
        failed: Exception | None = None
        for r in readers:
            try:
                return r(paths)
            except Exception as e:  # noqa: BLE001  the next reader is asked
                failed = e
        raise OSError("no reader could read the files") from failed

    return read


def usual_reader() -> Reader:
    """The open process, one process per list, Pillow: by what this machine has. To be called on the tasks."""
    from tidemark.sources.images import pillow_records

    tools: list[Reader] = [OpenReader().read, read_once] if shutil.which(PROGRAM) else []
    return first_that_works([*tools, pillow_records])


