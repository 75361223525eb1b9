"""Best-fit packing of token sequences by linear grouping.

Only lengths decide how to pack, and there are at most ``capacity`` of them, so a histogram is
all the driver sees, at any corpus size. Large lengths are sorted and cut into groups of
equal cardinality; within a group each is rounded up to the longest. With few sizes left, good
configurations (which sizes share a sequence) are found by dynamic programming and used many
times over. Then actual lengths replace the rounded ones, which leaves room, and small
lengths go best-fit into the fullest sequence that takes them. Every step works on runs of equal
sequences, so the plan is a table of runs: pieces of a length, by rank, go to consecutive
sequences. Pieces get their rank within a length from salted counts, without one hot window.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.latin import LETTERS, NUMBERS, SPACES, is_plain
from tidemark.llm.shared import enter, forget_with, id_text, leave, materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The split that lower-casing BPE vocabularies of this kind state in their files, over plain
#: Latin texts and with words first.
WORD_SPLIT = rf"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"


class WordIds:
    """Ids as little-endian unsigned 32-bit bytes; the library encodes each distinct word once.

    Texts that are plain Latin once normalised are split here and their words looked up; other
    texts, and texts with special strings, go to the library whole. Words are remembered in two generations of about
    ``memory`` each: when the younger is full it takes the place of the older, from which words
    in use come back.
    """

    def __init__(self, path: str, memory: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; threads that wait for small batches burn cores
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: The same for words that are split and normalised already.
        self._words = Tokenizer.from_str(self.library.to_str())
        self._words.normalizer = normalizers.Sequence([])
        self._words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._split = re.compile(WORD_SPLIT)
        self._memory: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._most = memory

    @staticmethod
    def _ids(library, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words that are new to the memory go to the library in one call."""
        normal = [unicodedata.normalize("NFC", t).lower() for t in texts]
        split = [self._split.findall(n) if "<|" not in t and is_plain(n) else None for t, n in zip(texts, normal, strict=True)]
        if len(self._memory) > self._most:
            self._older, self._memory = self._memory, {}
        memory, older = self._memory, self._older
        missing = set().union(*(words for words in split if words is not None)).difference(memory)
        memory.update((w, older[w]) for w in missing if w in older)
        new = [w for w in missing if w not in older]
        memory.update(zip(new, self._ids(self._words, new), strict=True))
        whole = iter(self._ids(self.library, [t for t, words in zip(texts, split, strict=True) if words is None]))
        return [next(whole) if words is None else b"".join(map(memory.__getitem__, words)) for words in split]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


forget_with(word_ids.cache_clear)


def token_pieces(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every text's ids, closed by ``end_id``, into pieces of ``capacity``; the last may be shorter.

    Null text is empty: one piece that holds ``end_id`` alone. Repeated rows give repeated pieces.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        ids = word_ids(path)
        for b in batches:
            rows: list[tuple] = []
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                for doc, data in zip(part.column(0).to_pylist(), ids.encode_many(part.column(1).to_pylist()), strict=True):
                    data += end
                    n = len(data) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        rows.append((doc, k, at, min(capacity, n - at), zlib.crc32(data[4 * at : 4 * (at + capacity)])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])
        leave()

    return id_text(df, id_col, text_col).mapInArrow(run, PIECES)


def _group(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut a falling list of (length, count) into ``groups`` runs of equal cardinality."""
    total = sum(n for _, n in lengths)
    each = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = each
            m = min(n, room)
            out[-1].append((length, m))
            n, room = n - m, room - m
    return out


def _best_fill(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Group indices, each at most as often as it is left, whose sizes fill ``room`` best.

    Bounded subset sums over few sizes, each sum reached with as large sizes as can be; ``sizes``
    fall. Sums are kept exactly: there are at most ``capacity`` of them.
    """
    came = {0: (-1, 0)}
    reach = [0]
    for g, size in enumerate(sizes):
        most = min(left[g], room // size) if size <= room else 0
        used = {}
        for base in sorted(reach):
            s, times = base, 0
            while times < most and s + size <= room:
                times += 1
                s += size
                if s in came:
                    break
                came[s] = (g, s - size)
                used[s] = True
        reach += list(used)
        if room in came:
            break
    s, picked = max(came), []
    while s:
        g, s = came[s]
        picked.append(g)
    return picked


def plan(histogram: dict[int, int], capacity: int, groups: int = 400, large_from: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) and the number of sequences.

    Piece ``r`` of a run goes to sequence ``first sequence + r - first rank`` at ``offset``. Lengths
    from ``large_from`` (a third of the capacity) are grouped and configured, smaller ones are
    best-fitted. Ties go to the longer length, then to the older sequence.
    """
    large_from = large_from or max(2, capacity // 3)
    full = histogram.get(capacity, 0)
    large = sorted(((n, c) for n, c in histogram.items() if large_from <= n < capacity and c), reverse=True)
    grouped = _group(large, groups)
    sizes = [g[0][0] for g in grouped]
    left = [sum(c for _, c in g) for g in grouped]

    # Configurations: always around the largest size that is left, used as often as the stock allows.
    uses: list[tuple[Counter, int]] = []
    first = 0
    while True:
        while first < len(left) and not left[first]:
            first += 1
        if first == len(left):
            break
        left[first] -= 1
        chosen = Counter([first, *_best_fill(sizes, left, capacity - sizes[first])])
        left[first] += 1
        times = min(left[g] // k for g, k in chosen.items())
        for g, k in chosen.items():
            left[g] -= k * times
        uses.append((chosen, times))

    # Substitution: the actual lengths of a group, falling, take its slots in turn.
    stock = [[list(x) for x in g] for g in grouped]
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)
    sequences = 0
    if full:
        runs.append((capacity, 0, full, 0, 0))
        sequences = full
    for chosen, times in uses:
        slots = [g for g in sorted(chosen) for _ in range(chosen[g])]
        pieces = [(0, times, 0)]  # (sequence within this use, count, filled so far)
        for g in slots:
            after = []
            for at, count, filled in pieces:
                while count:
                    length, have = stock[g][0]
                    m = min(count, have)
                    runs.append((length, taken[length], m, sequences + at, filled))
                    taken[length] += m
                    after.append((at, m, filled + length))
                    at, count = at + m, count - m
                    stock[g][0][1] -= m
                    if not stock[g][0][1]:
                        stock[g].pop(0)
            pieces = after
        for at, count, filled in pieces:
            open_runs[capacity - filled].append((sequences + at, count))
        sequences += times

    # Small lengths, falling: best fit, many at a time.
    rooms = sorted(open_runs)
    for length in sorted((n for n, c in histogram.items() if n < large_from and c), reverse=True):
        count = histogram[length]
        while count:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                fit = capacity // length
                opened = -(-count // fit)
                room, run = capacity, (sequences, opened)
                sequences += opened
            else:
                room = rooms[k]
                run = open_runs[room].pop(0)
                if not open_runs[room]:
                    del open_runs[room]
                    rooms.pop(k)
            at, have = run
            fit = room // length
            whole = min(have, count // fit)  # sequences that take as many of this length as they hold
            parts = [(at, whole, fit)] if whole else []
            rest = count - whole * fit
            if whole < have and rest and (not whole or rest < fit):
                parts.append((at + whole, 1, min(rest, fit)))
            used = sum(m for _, m, _ in parts)
            for start, m, times in parts:
                for j in range(times):
                    runs.append((length, taken[length], m, start, capacity - room + j * length))
                    taken[length] += m
                    count -= m
                _put(rooms, open_runs, room - times * length, start, m)
            if used < have:
                _put(rooms, open_runs, room, at + used, have - used)
    return runs, sequences


def _put(rooms: list[int], open_runs: dict[int, list[tuple[int, int]]], room: int, at: int, count: int) -> None:
    if room <= 0:
        return
    if room not in open_runs:
        bisect.insort(rooms, room)
    open_runs[room].append((at, count))


def best_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan by groups or, if that needs fewer sequences, plain best fit of falling lengths."""
    return min((plan(histogram, capacity), plan(histogram, capacity, large_from=capacity)), key=lambda p: p[1])


def pack(pieces: DataFrame, capacity: int = 4096, salt_rows: int = 50_000) -> DataFrame:
    """``pieces`` (of :func:`token_pieces`, already written: it is read twice) plus sequence_id and offset.

    Sequences hold at most ``capacity`` tokens and have no gaps from 0. Piece order within
    a length is that of a hash, so copies and hot sources do not gather.
    """
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    histogram = {int(r.length): int(r.n) for r in counts}
    runs, _ = best_plan(histogram, capacity)
    table: dict[int, list[tuple]] = defaultdict(list)
    for length, *run in runs:
        table[length].append(tuple(run))
    arrays = {n: np.array(sorted(v), np.int64).reshape(-1, 4) for n, v in table.items()}
    sent = pieces.sparkSession.sparkContext.broadcast(arrays)  # bounded by lengths and groups, not by pieces

    salts = {n: max(1, -(-c // salt_rows)) for n, c in histogram.items()}
    most = max(salts.values(), default=1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(most)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "base")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(offsets, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            length, nth = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty_like(nth), np.empty_like(nth)
            order = np.argsort(length, kind="stable")
            cuts = np.nonzero(np.diff(length[order]))[0] + 1
            for part in np.split(order, cuts) if len(order) else []:
                t = known[int(length[part[0]])]
                k = np.searchsorted(t[:, 0], nth[part], "right") - 1
                sequence[part] = t[k, 2] + nth[part] - t[k, 0]
                offset[part] = t[k, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("nth").cast("long").alias("nth")).mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenize, cut, write the pieces once, pack. An empty table gives no rows."""
    return pack(materialize(token_pieces(df, path, capacity, end_id), "pieces"), capacity)
