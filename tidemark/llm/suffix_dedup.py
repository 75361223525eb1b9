"""Suffix-array dedup: remove every byte of a 100-byte string that also starts earlier.

Suffixes of a whole corpus do not fit one array, and need not: a window of ``LENGTH`` bytes is
routed by its *anchor*, the GRAM-byte string in it with the least hash. Equal windows have equal
anchors, so they meet, and consecutive windows mostly share one. Anchors that occur once cannot
hold a repeated window; only the others' contexts (a run of windows with one anchor) travel.
Contexts that are equal as a whole count once; what is left of an anchor goes into a block, whose
suffix array is built in two stages: suffixes smaller than their successors are sorted directly,
the others are induced by scanning the buckets of first bytes. Adjacent common prefixes of at
least ``LENGTH`` then give the classes of equal windows, of which only the first stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_table, enter, id_text, leave, materialize

LENGTH, GRAM = 100, 24
#: Anchors with more occurrences are split by windows.
HOT = 20_000
_CHUNK, _POS = 1 << 19, 20
_C = np.uint64(0x9E3779B97F4A7C15)


def two_stage_suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``s`` (uint8, ending in its only-or-repeated least symbol 0), ordered by at least ``depth`` bytes.

    Suffixes alike over ``depth`` bytes stand together, in any order.
    """
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int16)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    ascending = np.zeros(n, bool)  # suffix i < suffix i + 1; the last one is not
    inner = nxt < n - 1
    ascending[:-1][inner] = step[nxt[inner]] > 0

    # Stage one: direct sort of the ascending suffixes.
    own = np.flatnonzero(ascending)
    padded = np.concatenate([s, np.zeros(depth + 8, np.uint8)])
    order = own
    if len(own):
        words = -(-depth // 8)
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)
        word = lambda i, j: np.ascontiguousarray(view[i + 8 * j]).view(">u8")[:, 0].astype(np.uint64)
        key = word(own, 0)
        order = own[np.argsort(key, kind="stable")]
        key.sort()
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        for j in range(1, words):
            same = group[1:] == group[:-1]
            tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            where = np.flatnonzero(tied)
            if not len(where):
                break
            k, g = word(order[where], j), group[where]
            by = np.lexsort((k, g))
            order[where] = order[where][by]
            k, g = k[by], g[by]
            cut = np.zeros(len(group), np.int64)
            cut[where[1:]] = (g[1:] == g[:-1]) & (k[1:] != k[:-1])
            group = group + np.cumsum(cut)

    # Stage two: induce the others, bucket by bucket of the first byte.
    first = s[order]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[s[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        fresh = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        descending = [fresh]
        while True:
            before = fresh[fresh > 0] - 1
            before = before[~ascending[before]]
            here = s[before] == c
            _spread(before[~here], s, waiting)
            fresh = before[here]
            if not len(fresh):
                break
            descending.append(fresh)
        straight = order[bounds[c] : bounds[c + 1]]
        before = straight[straight > 0] - 1
        _spread(before[~ascending[before]], s, waiting)
        out += [*descending, straight]
    return np.concatenate(out)


def _spread(found: np.ndarray, s: np.ndarray, waiting: list[list[np.ndarray]]) -> None:
    if not len(found):
        return
    symbols = s[found]
    by = np.argsort(symbols, kind="stable")
    found, symbols = found[by], symbols[by]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part in np.split(found, cuts):
        waiting[s[part[0]]].append(part)


def repeated_windows(contexts: list[bytes], windows: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its first ``windows`` windows equal one in an earlier context or place."""
    parts, starts, at = [], [], 0
    for c in contexts:
        starts.append(at)
        parts += [np.frombuffer(c, np.uint8) + np.uint8(1), np.zeros(1, np.uint8)]  # UTF-8 has no byte 255
        at += len(c) + 1
    s = np.concatenate(parts)
    valid = np.zeros(len(s), bool)
    for a, n in zip(starts, windows, strict=True):
        valid[a : a + n] = True
    sa = two_stage_suffix_array(s, length)
    sa = sa[valid[sa]]
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    alive = np.arange(1, len(sa))  # places in sa whose prefix equals the one's before, so far
    for j in [*range(0, length - 7, 8), length - 8]:
        a, b = view[sa[alive] + j], view[sa[alive - 1] + j]
        alive = alive[(np.ascontiguousarray(a).view(np.uint64) == np.ascontiguousarray(b).view(np.uint64))[:, 0]]
    joined = np.zeros(len(sa), bool)
    joined[alive] = True
    heads = np.flatnonzero(~joined)
    repeated = np.zeros(len(s), bool)
    if len(heads):
        earliest = np.minimum.reduceat(sa, heads)
        repeated[sa] = True
        repeated[earliest] = False
    return [repeated[a : a + n] for a, n in zip(starts, windows, strict=True)]


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM-byte string, by doubling."""
    with np.errstate(over="ignore"):
        h, powers, n = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), {}, 1
        c = _C
        while n < GRAM:
            powers[n] = h
            m = n if 2 * n <= GRAM else GRAM - n  # GRAM = 24: 1, 2, 4, 8, 16, then 16 + 8
            tail = powers[m] if m in powers else h
            size = len(b) - (n + m) + 1
            h = (h[:size] * c) ^ (h[:size] >> np.uint64(31)) if size > 0 else np.zeros(0, np.uint64)
            h = h + tail[n : n + max(size, 0)]
            c = c * _C + np.uint64(2)
            n += m
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def anchor_runs(b: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of the runs of windows of ``b`` (at most 2^20 bytes) that share an anchor."""
    n = len(b) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 3
    g = _grams(b)
    x = (g & ~np.uint64((1 << _POS) - 1)) | np.arange(len(g), dtype=np.uint64)
    width, span = 1, length - GRAM + 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < span:
        x = np.minimum(x[: len(x) - (span - width)], x[span - width :])
    where = (x[:n] & np.uint64((1 << _POS) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
    return g[where[first]], first, np.diff(np.concatenate([first, [n]]))


def _runs_of_batch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row in the batch, anchor, first window in the row, windows), over the rows put together."""
    out, piece, held = [], [], 0

    def settle() -> None:
        nonlocal piece, held
        if not piece:
            return
        b = np.frombuffer(b"".join(p[2] for p in piece), np.uint8)
        sizes = np.array([len(p[2]) for p in piece])
        begin = np.cumsum(sizes) - sizes
        v, first, n = anchor_runs(b)
        # Cut runs at the ends of rows and drop windows that reach over one.
        owner = np.searchsorted(begin, first, "right") - 1
        last = first + n - 1
        reach = begin + sizes - LENGTH
        cross = np.flatnonzero(np.searchsorted(begin, last, "right") - 1 != owner)
        extra = [(v[k], max(int(begin[o]), int(first[k])), min(int(last[k]), int(reach[o])), o) for k in cross for o in range(owner[k] + 1, int(np.searchsorted(begin, last[k], "right")))]
        last = np.minimum(last, reach[owner])
        keep = last >= first
        v, first, last, owner = v[keep], first[keep], last[keep], owner[keep]
        extra = [e for e in extra if e[2] >= e[1]]
        if extra:
            v = np.concatenate([v, np.array([e[0] for e in extra], np.uint64)])
            first, last, owner = (np.concatenate([a, np.array([e[k] for e in extra], np.int64)]) for a, k in ((first, 1), (last, 2), (owner, 3)))
        rows, base = np.array([p[0] for p in piece]), np.array([p[1] for p in piece])
        out.append((rows[owner], v, first - begin[owner] + base[owner], last - first + 1))
        piece, held = [], 0

    for r, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), _CHUNK):
            part = t[at : at + _CHUNK + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if held + len(part) > _CHUNK + LENGTH:
                settle()
            piece.append((r, at, part))
            held += len(part)
    settle()
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def anchors(docs: DataFrame) -> DataFrame:
    """(v, doc_id, run): every anchor run, ``run`` = first window * 128 + number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffixes")
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                rows, v, first, n = _runs_of_batch([t.as_py().encode("utf-8") for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), part.column(0).take(pa.array(rows)), pa.array(first * 128 + n)], ["v", "doc_id", "run"])
        leave()

    return docs.mapInArrow(run, "v long, doc_id long, run long")


_SPANS = "doc_id long, first long, n long"


def _contexts(joined: DataFrame) -> DataFrame:
    """The contexts behind repeated anchors; one that its task has seen before travels without its bytes (n < 0).

    Contexts of a hot anchor travel window by window, each by its own hash, so that no anchor gathers
    more than its equal windows, of which one is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffixes")
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows: list[tuple] = []
                for doc, text, runs in zip(*(part.column(c) for c in range(3)), strict=True):
                    doc, data = doc.as_py(), text.as_py().encode("utf-8")
                    for r in sorted(runs.as_py(), key=lambda r: r["run"]):
                        v, first, n = r["v"], r["run"] // 128, r["run"] % 128
                        context = data[first : first + n + LENGTH - 1]
                        n = len(context) - LENGTH + 1
                        if n < 1:  # another row of this id has a longer text
                            continue
                        key = (v, xxhash.xxh3_64_intdigest(context))
                        before = seen.get(key)
                        if before is not None and before < (doc, first):
                            rows.append((xxhash.xxh3_64_intdigest(first.to_bytes(8, "little"), doc & 0xFFFF) - (1 << 63), doc, first, -n, None))
                            continue
                        if len(seen) > 200_000:
                            seen.clear()
                        seen[key] = (doc, first)
                        if r["hot"]:
                            for i in range(n):
                                w = context[i : i + LENGTH]
                                rows.append((xxhash.xxh3_64_intdigest(w) - (1 << 63), doc, first + i, 1, w))
                        else:
                            rows.append((v, doc, first, n, context))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["v", "doc_id", "first", "n", "context"])
        del seen
        leave()

    return joined.mapInArrow(run, "v long, doc_id long, first long, n long, context binary")


def _resolve(batches: Iterator[pa.RecordBatch], block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (v, doc_id, first) to the repeated windows' runs (doc_id, first, n)."""
    out: list[tuple[int, int, int]] = []
    group: dict[bytes, tuple[int, int, int]] = {}
    waiting: list[tuple[bytes, int, int, int]] = []
    held = 0
    last_v = None

    def close_group() -> None:
        nonlocal held
        if len(group) > 1:
            for c, (doc, first, n) in group.items():
                waiting.append((c, doc, first, n))
                held += len(c)
        group.clear()

    def settle() -> None:
        nonlocal held
        if waiting:
            found = repeated_windows([w[0] for w in waiting], [w[3] for w in waiting])
            for (_, doc, first, _n), hit in zip(waiting, found, strict=True):
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    out.extend((doc, first + int(a), int(e - a)) for a, e in zip(edge[::2], edge[1::2], strict=True))
            waiting.clear()
        held = 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "first", "n"])

    for b in batches:
        for v, doc, first, n, context in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
            if n < 0:
                out.append((doc, first, -n))
                continue
            if v != last_v:
                close_group()
                last_v = v
                if held > block:
                    settle()
            c = context.as_py()
            same = group.get(c)
            if same is not None:
                if same[:2] != (doc, first):  # else a repeated row: not earlier than itself
                    out.append((doc, first, n))
            else:
                group[c] = (doc, first, n)
        yield flush()
    close_group()
    settle()
    yield flush()
    leave()


def removable(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, runs): per document the runs (first window, windows) that also start earlier. ``docs`` is (doc_id, text).

    The repeated anchors and the result are written, so that one step's shuffle is gone before the next.
    """
    spark = docs.sparkSession
    every = materialize(anchors(docs), "anchor-runs")
    # Written before it is joined, so that the join on a hot anchor can be split.
    often = materialize(every.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v", (F.col("c") > hot).alias("hot")), "anchors-often")
    repeated = materialize(every.join(often, "v").groupBy("doc_id").agg(F.collect_list(F.struct("v", "run", "hot")).alias("runs")), "anchors")
    drop_table(spark, every, often)
    contexts = _contexts(docs.join(repeated, "doc_id").select("doc_id", "text", "runs"))
    spans = contexts.repartition("v").sortWithinPartitions("v", "doc_id", "first").mapInArrow(_resolve, _SPANS)
    found = materialize(spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("runs")), "repeats")
    drop_table(spark, repeated)
    return found


def cut(data: bytes, runs: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int]:
    """``data`` without the bytes under the runs' windows, and how many maximal stretches went."""
    kept, at, stretches = [], 0, 0
    end = -1
    for first, n in sorted(runs):
        stop = first + n - 1 + length
        if first > end:
            kept.append(data[at:first])
            stretches += 1
        end = max(end, stop)
        at = max(at, stop)
    kept.append(data[at:])
    return b"".join(kept), stretches


def apply_cuts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) of every document.

    Null text is empty. Ids order the texts. Rows that repeat count as one document and are cut
    alike; different texts of one id are cut at the union of their places. Rows without id keep
    all bytes, and no other text is compared with them.
    """
    docs = id_text(documents, id_col, text_col)
    runs = removable(docs.where(F.col("doc_id").isNotNull()))
    joined = docs.join(runs, "doc_id", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, gone, spans = [], [], [], []
            for text, r in zip(b.column(1), b.column(2), strict=True):
                data = text.as_py().encode("utf-8")
                left, k = cut(data, [(x["first"], x["n"]) for x in r.as_py() or []])
                kept.append(left)
                n.append(len(data))
                gone.append(len(data) - len(left))
                spans.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, gone, spans))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def dedup_text(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the removable bytes cut out of the text; characters cut in half go with them."""
    kept = apply_cuts(documents, id_col, text_col).where("n_removed > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py().decode("utf-8", "ignore") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["_id", "_kept"])

    cuts = kept.select("doc_id", "kept").mapInArrow(run, "_id long, _kept string")
    out = documents.join(cuts, documents[id_col].cast("long") == cuts["_id"], "left")
    return out.select(*[F.coalesce(cuts["_kept"], documents[c]).alias(c) if c == text_col else documents[c] for c in documents.columns])
