"""N-gram Jaccard join: exact links between word-shingle sets, as a metric-space join.

**Regions.** The Jaccard distance 1 - J is a metric, but two texts that are not near copies share
almost no 5-word shingles: they lie at distance 1 from almost every document, and Voronoi regions
of documents would not part them. The first pivots are therefore the one-shingle sets. A document
lies nearer to the pivots it contains (1 - 1/n) than to all others (1); ties go by one global
order, common shingles last, then by hash, so its Voronoi region is that of its first shingle.
By the triangle inequality for the symmetric difference, |A xor B| <= (1-t)/(1+t) (|A| + |B|)
for a linked pair: not more than n - ceil(t n) of a document's shingles can be missing in a
partner. So the pair meets in the region of a shingle among the first n - ceil(t n) + 1 of both,
and boundary documents are copied into exactly those regions (their window).

**Recursion.** Regions of more than FEW members get pivot documents. Within them the distance is
H, in how many of BITS hash classes of shingles two sets differ in parity: a pseudometric, and
never above |A xor B|. First all members are compared with one pivot; then each member goes to
the cell of its nearest pivot document (Voronoi) and, by the triangle inequality, is copied into
the cell of each pivot p with H(x, p) <= H(x, nearest) + 2 d(x), where d(x) = (1-t)/t |x| is the
farthest that a partner of x can be. A linked pair thus meets in the home cell of either document.
Regions of which some members, asked beforehand, would be copied into most cells stay whole.
Links with pivots merge components; a region or cell in one component is done. In the cells of
the last level members of different components are compared, if H allows a link.

Candidates are verified on their full sets. Sets that are equal are one vertex from the start.
A link inside a component would change nothing, so components are exact and no group emits all
its pairs. The operator yields components, not all links within them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import drop_table, enter, id_text, leave, materialize

WORDS = 5
#: Regions of so many members are joined pair by pair.
FEW = 6
#: Shingles that a task meets in this many different texts are reported as common, and at most
#: so many of all tasks' reports are sent back (the order only has to be the same everywhere).
COMMON_IN_TASK, MOST_COMMON = 3, 1 << 18
#: Hash classes of shingles whose parities are kept for each document, and pivots of a region by level.
BITS, PIVOTS = 1024, (1, 4)
#: Sets of more shingles than LONG get FINE classes too, as BITS of them say little about so many.
LONG, FINE = 1000, 16384
#: Members of a region that are asked whether cells would part them; where they would not, the region stays whole.
PROBES = 3
#: So many pairs of vertices (two ids each), checked by a count, are sent to every task.
_SENT = 500_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _WordHashes(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of 64-bit shingle hashes; word hashes are remembered, about ``memory`` of them."""

    def __init__(self, words: int = WORDS, memory: int = 150_000):
        self.words, self._memory, self._most = words, _WordHashes(), memory

    def set_of(self, text: str) -> np.ndarray:
        """The sorted distinct shingle hashes; shorter texts are one shingle, texts without words none."""
        words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        if len(self._memory) > self._most:
            self._memory.clear()
        h = np.fromiter(map(self._memory.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        s = h[:n] * _MIX[0]
        for j in range(1, k):
            s += h[j : j + n] * _MIX[j]
        s ^= s >> np.uint64(32)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(29)
        s += np.uint64(k)
        s.sort()
        return s if n == 1 else s[np.concatenate([[True], s[1:] != s[:-1]])]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def node_of(s: np.ndarray) -> int:
    """The vertex of a set: a hash of all its shingles."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def parities(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each of ``bits`` hash classes, a power of two, whether the set has an odd number of it: packed in longs."""
    held = np.bincount((s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits)
    return np.packbits((held & 1).astype(np.uint8)).view(np.int64)


def common_shingles(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """At most MOST_COMMON shingles that some task met in COMMON_IN_TASK different sets, the most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        shingler, seen, waiting, held = Shingler(words), set(), [], 0
        tally: Counter = Counter()

        def settle(least: int) -> None:
            if waiting:
                values, n = np.unique(np.concatenate(waiting), return_counts=True)
                often = n >= least
                tally.update(dict(zip(values[often].tolist(), n[often].tolist(), strict=True)))
                waiting.clear()

        for b in batches:
            for t in b.column(1):
                s = shingler.set_of(t.as_py())
                node = node_of(s)
                if len(s) and node not in seen:
                    if len(seen) < 200_000:
                        seen.add(node)
                    waiting.append(s)
                    held += len(s)
                    if held > 4_000_000:
                        settle(COMMON_IN_TASK)
                        held = 0
        settle(COMMON_IN_TASK)
        found = pa.RecordBatch.from_arrays([pa.array(_signed(np.array(list(tally), np.uint64))), pa.array(list(tally.values()), pa.int64())], ["s", "n"])
        del shingler, seen, tally, waiting
        yield found
        leave()

    counts = docs.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(MOST_COMMON)
    return counts.select("s").toPandas()["s"].to_numpy(np.int64).view(np.uint64)  # at most MOST_COMMON


def windows(docs: DataFrame, common: np.ndarray, threshold: tuple[int, int] = (75, 100), words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, node, window, parity, fine): each text's vertex and, for a task's first text of a vertex, its
    regions' shingles in order and its parities (fine ones of large sets). Texts without words have node null."""
    num, den = threshold
    order = np.argsort(common)
    sent = docs.sparkSession.sparkContext.broadcast((common[order], (len(common) - order).astype(np.int64)))  # at most MOST_COMMON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        known, rank = sent.value
        shingler, seen = Shingler(words), set()
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                size, node, window, ends, parity, fine = [], [], [], [0], [], []
                for t in part.column(1):
                    s = shingler.set_of(t.as_py())
                    n = len(s)
                    size.append(n)
                    node.append(node_of(s) if n else None)
                    if n and node[-1] not in seen:
                        if len(seen) < 200_000:
                            seen.add(node[-1])
                        p = n - -(-num * n // den) + 1
                        if len(known):
                            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                            heavy = np.where(known[at] == s, rank[at], 0)
                            s = s[np.lexsort((s, heavy))] if heavy.any() else s
                        parity.append(parities(s))
                        fine.append(parities(s, FINE) if n > LONG else None)
                        window.append(s[:p])
                        ends.append(ends[-1] + p)
                    else:
                        parity.append(None)
                        fine.append(None)
                        ends.append(ends[-1])
                flat = _signed(np.concatenate(window)) if window else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(node, pa.int64()), lists, *(pa.array(x, pa.list_(pa.int64())) for x in (parity, fine))], ["doc_id", "n_shingles", "node", "window", "parity", "fine"])
        del shingler, seen
        leave()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, window array<long>, parity array<long>, fine array<long>")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, s) of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        shingler = Shingler(words)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                found = [s for s in (shingler.set_of(t.as_py()) for t in b.slice(k, 512).column(1)) if len(s)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                flat = _signed(np.concatenate(found)) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "s"])
        del shingler
        leave()

    return docs.mapInArrow(run, "node long, s array<long>")


def _apart(a: Column | str, b: Column | str) -> Column:
    """H, from two columns of parities."""
    differ = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)]
    return sum(differ[1:], differ[0])


def _cells(parity: Column, size: Column, pivots: Column, num: int, den: int) -> Column:
    """The numbers of the pivots whose cells a member is in, its own (the nearest) first."""
    near = F.array_sort(F.transform(pivots, lambda p, i: F.struct(_apart(parity, p["parity"]).alias("h"), i.alias("i"))))
    reach = lambda n: F.get(n, F.lit(0))["h"] + 2 * F.floor((den - num) * size / num)
    inside = F.transform(F.array(near), lambda n: F.filter(n, lambda x: x["h"] <= reach(n)))  # so that ``near`` is computed once
    return F.transform(F.get(inside, F.lit(0)), lambda x: x["i"])


def _possible(pairs: DataFrame, fine: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (u, v) less those of two large sets that differ in too many of the fine classes. ``fine``: (node, size, fine)."""
    side = lambda name, k: fine.select(F.col("node").alias(name), F.col("size").alias(f"n{k}"), F.col("fine").alias(f"f{k}"))
    differ = F.aggregate(F.zip_with("f1", "f2", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, x: t + x)
    far = (den + num) * differ > (den - num) * (F.col("n1") + F.col("n2"))
    return pairs.join(side("u", 1), "u", "left").join(side("v", 2), "v", "left").where(~F.coalesce(far, F.lit(False))).select("u", "v")


def _verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """The links among ``pairs`` (u, v), which are written already; full sets are made for their texts alone."""
    small = pairs.count() <= _SENT  # then pairs and ids go to the texts; else texts are shuffled
    sent = F.broadcast if small else lambda d: d
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    chosen = materialize(first.join(sent(wanted), "node").select("node", "doc_id"), "jaccard-texts")
    texts = docs.join(sent(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = materialize(shingle_sets(texts, words).join(sent(chosen.select("node")), "node", "left_semi"), "jaccard-sets")
    made = sets
    if sets.count() > chosen.count():  # ids that repeat
        sets = sets.dropDuplicates(["node"])
    a, b = sets.select(F.col("node").alias("u"), F.col("s").alias("s1")), sets.select(F.col("node").alias("v"), F.col("s").alias("s2"))
    both = F.size(F.array_intersect("s1", "s2"))
    good = materialize(a.join(sent(pairs), "u").join(b, "v").where(den * both >= num * (F.size("s1") + F.size("s2") - both)).select("u", "v"), "jaccard-links")
    drop_table(docs.sparkSession, made, chosen)
    return good


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the cells (s, cell) that lie in several components, with ``c``, theirs."""
    named = members.join(comp.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    several = named.groupBy("s", "cell").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("home").alias("homes")).where("lo < hi AND homes")
    return named.join(several.select("s", "cell"), ["s", "cell"])


def link_classes(documents: DataFrame, threshold: tuple[int, int] = (75, 100), words: int = WORDS, pivots: tuple[int, ...] = PIVOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_equal): every row with its class.

    Texts are linked if num/den of the union of their shingle sets is in both. ``component_id`` is
    the smallest id reachable, ``n_equal`` counts the rows with the same set. Null and empty texts,
    and texts of white space, have no shingles and are classes of their own, as are rows without
    id. Rows that share an id are one vertex for numbering but are compared text by text.
    ``pivots``: how many pivot documents a region gets at each level.
    """
    num, den = threshold
    spark = documents.sparkSession
    docs = id_text(documents, id_col, text_col)
    common = common_shingles(docs, words)
    vertex = materialize(windows(docs, common, threshold, words), "jaccard-vertices")
    every = vertex.select("node", (F.col("n_shingles") * (1 << 32)).alias("size"), F.posexplode("window").alias("place", "s"))
    every = every.select("s", "node", (F.col("size") + F.col("place")).alias("where"))  # packed, as every row is shuffled
    # Written before it is joined, so that a join on a hot shingle can be split. n counts a text once for each task that met it.
    shared = every.groupBy("s").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("s", (F.col("n") > FEW).alias("many"))
    shared = materialize(shared, "jaccard-shared")
    met = every.join(shared, "s").select("s", "many", "node", F.shiftright("where", 32).cast("int").alias("size"), F.col("where").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"))
    member = materialize(met.distinct(), "jaccard-members")

    known = vertex.where("parity IS NOT NULL").select("node", F.col("n_shingles").alias("size"), "parity", "fine").join(member.select("node").distinct(), "node", "left_semi")
    both = materialize(known.dropDuplicates(["node"]), "jaccard-parities")
    parity, fine = both.select("node", "parity"), both.where("fine IS NOT NULL").select("node", "size", "fine")
    first = materialize(vertex.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_equal")), "jaccard-firsts")
    rows = materialize(vertex.select("doc_id", "n_shingles", "node"), "jaccard-nodes")
    drop_table(spark, vertex)

    near = (den + num) * F.least(F.col("size") - F.col("place"), F.col("csize") - F.col("cplace")) >= num * (F.col("size") + F.col("csize"))
    apart = (den + num) * _apart("parity", "cparity") <= (den - num) * (F.col("size") + F.col("csize"))
    ends = [F.least("node", "cnode").alias("u"), F.greatest("node", "cnode").alias("v")]
    other = [F.col(c).alias(f"c{c}") for c in ("node", "size", "place")]
    small = member.where("NOT many")
    few = small.join(small.select("s", *other), "s").where("node < cnode").where(near).select("node", "size", "cnode", "csize").distinct()
    few = few.join(parity, "node").join(parity.select(F.col("node").alias("cnode"), F.col("parity").alias("cparity")), "cnode").where(apart).select(*ends)
    few = materialize(few, "jaccard-few")
    large = member.where("many").join(parity, "node")
    left = materialize(large.select("s", "node", "size", "place", "parity", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home")), "jaccard-large")
    drop_table(spark, member, shared)

    comp, more = None, few
    for n in (*pivots, 0):
        if comp is None:  # all are open
            named = left.withColumn("c", F.col("node"))
        else:
            named, before = materialize(_open(left, comp), "jaccard-open"), left
            drop_table(spark, before)
        place = [F.col(c).alias(f"c{c}") for c in ("node", "size", "place", "parity", "c")]
        if n:
            whole = [F.col(c) for c in ("node", "size", "place", "parity", "c")]
            picked = [F.min(F.struct(F.xxhash64("node", "s", "cell", F.lit(i)).alias("k"), *whole)) for i in range(n + PROBES * (n > 1))]
            chosen = named.groupBy("s", "cell").agg(F.array(*picked).alias("all")).withColumn("ps", F.slice("all", 1, n))
            if n > 1:  # members that are no pivots tell whether cells would be smaller than the region
                copies = F.transform(F.slice("all", n + 1, PROBES), lambda q: F.size(_cells(q["parity"], q["size"], F.col("ps"), num, den)))
                chosen = chosen.withColumn("parts", F.aggregate(copies, F.lit(0), lambda t, k: t + k) <= PROBES * n / 2)
            beside = named.join(chosen.drop("all"), ["s", "cell"])
            size = lambda p: F.col("size") + p["size"]
            close = lambda p: (den + num) * F.least(F.col("size") - F.col("place"), p["size"] - p["place"]) >= num * size(p)
            linked = lambda p: (p["c"] != F.col("c")) & close(p) & ((den + num) * _apart("parity", p["parity"]) <= (den - num) * size(p))
            met = beside.select("node", F.explode(F.filter("ps", linked)).alias("p"))
            pairs = met.select("node", F.col("p.node").alias("cnode")).select(*ends)
            kept = ["s", "node", "size", "place", "parity"]
            if n > 1:
                split = beside.where("parts").select(*kept, "cell", "home", F.posexplode(_cells(F.col("parity"), F.col("size"), F.col("ps"), num, den)).alias("nth", "i"))
                split = split.select(*kept, F.xxhash64("cell", "i").alias("cell"), (F.col("home") & (F.col("nth") == 0)).alias("home"))
                left = materialize(split.union(beside.where("NOT parts").select(*kept, "cell", "home")), "jaccard-cells")
            else:
                left = named.select(*kept, "cell", "home")
        else:
            counts = named.groupBy("s", "cell", "c").agg(F.count("*").alias("n"))
            largest = counts.groupBy("s", "cell").agg(F.max(F.struct("n", "c")).alias("b")).select("s", "cell", F.col("b.c").alias("big"))
            outside = named.join(largest, ["s", "cell"]).where("c <> big").select("s", "cell", *place, F.col("home").alias("chome"))
            pairs = named.join(outside, ["s", "cell"]).where("c <> cc AND (home OR chome)").where(near).where(apart).select(*ends)
        pairs = materialize(_possible((pairs if more is None else pairs.union(more)).distinct(), fine, num, den), "jaccard-pairs")
        more = None
        good = _verified(pairs, first, docs, num, den, words)
        drop_table(spark, pairs, *([] if n == 1 else [named]))
        stars = [] if comp is None else [comp.select(F.col("id").alias("u"), F.col("component").alias("v"))]
        comp = components(reduce(DataFrame.union, [good, *stars]), label="jaccard-components")
    drop_table(spark, few, both)
    linked = first.join(comp, first["node"] == comp["id"], "left").select("node", "doc_id", "n_equal", F.coalesce("component", "node").alias("c"))
    smallest = linked.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    classes = linked.join(smallest, "c").select("node", "component_id", "n_equal")
    return rows.join(classes, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))
