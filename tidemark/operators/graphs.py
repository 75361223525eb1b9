"""Merge chains, similarity groups by bands of bits, connected components."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import bits, hamming
from tidemark.operators.grouping import numbered
from tidemark.sources.tables import stage, unstage


def roots(clusters: DataFrame) -> DataFrame:
    """(id, root): every node that a node without ``merged_into`` reaches; cycles reach none."""
    spark = clusters.sparkSession
    clusters.createOrReplaceTempView("_tm_clusters")
    return spark.sql(
        """WITH RECURSIVE r(id, root) AS (
             SELECT id, id FROM _tm_clusters WHERE merged_into IS NULL
             UNION ALL
             SELECT c.id, r.root FROM _tm_clusters c JOIN r ON c.merged_into = r.id
           ) SELECT id, root FROM r"""
    )


def root_of(clusters: DataFrame, node: int) -> int:
    found = roots(clusters).where(F.col("id") == node).first()
    if found is None:
        raise ValueError(f"no cluster {node} with a root")
    return found.root


def label_root(clusters: DataFrame, node: int, label: str) -> DataFrame:
    root = root_of(clusters, node)
    return clusters.withColumn("label", F.when(F.col("id") == root, F.lit(label)).otherwise(F.col("label")))


def merge_clusters(clusters: DataFrame, src: int, dst: int) -> DataFrame:
    """Hang the root of ``src`` below that of ``dst``; a label moves only to a root without one."""
    a, b = root_of(clusters, src), root_of(clusters, dst)
    if a == b:
        return clusters
    label = clusters.where(F.col("id") == a).first().label
    moved = clusters.withColumn("merged_into", F.when(F.col("id") == a, F.lit(b)).otherwise(F.col("merged_into")))
    return moved.withColumn("label", F.when((F.col("id") == b) & F.col("label").isNull(), F.lit(label)).otherwise(F.col("label")))


def person_files(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """(file_id, label, face_id, root): faces under labelled roots, markers left out."""
    named = roots(clusters).join(clusters.select(F.col("id").alias("root"), "label"), "root").where(F.col("label").isNotNull())
    real = faces.where(F.size("bbox") == 4)
    return real.join(named.withColumnRenamed("id", "cluster_id"), "cluster_id").select("file_id", "label", F.col("id").alias("face_id"), "root", "bbox")


#: So many signatures in a bucket of equal blocks are compared with each other without a thought.
_BUCKET = 64


def _blocks(n: int, most: int) -> int:
    """Into how many blocks 64 bits are cut. Two signatures within ``most`` bits agree in all blocks but ``most``: with
    more blocks more bits are known to agree, and buckets stay small as the signatures grow in number."""
    blocks = most + 1
    while blocks < most + 3 and n > _BUCKET * 2 ** (64 * (blocks - most) / blocks):
        blocks += 1
    return blocks


def _near_signatures(kinds: DataFrame, most: int) -> DataFrame:
    """(s1, s2): signatures of ``kinds`` (sig, each once, written already) of equal length and within reach, s1 < s2."""
    blocks = _blocks(kinds.count(), most)
    bitted = kinds.withColumn("bits", bits(F.col("sig"))).withColumn("n", F.length("bits"))
    at = lambda k: F.floor(F.col("n") * k / blocks).cast("int")
    part = [F.col("bits").substr(at(k) + 1, at(k + 1) - at(k)) for k in range(blocks)]
    keys = [F.concat_ws(":", F.col("n").cast("string"), F.lit(str(j)), *[part[k] for k in same]) for j, same in enumerate(combinations(range(blocks), blocks - most))]
    banded = bitted.select("sig", F.explode(F.array(*keys)).alias("band"))
    x, y = banded.select(F.col("sig").alias("s1"), "band"), banded.select(F.col("sig").alias("s2"), "band")
    return x.join(y, "band").where("s1 < s2").where(hamming(F.col("s1"), F.col("s2")) <= most).select("s1", "s2").distinct()


def _keyed(df: DataFrame, id_col: str, signature: str) -> DataFrame:
    """(id, sig): lower-case signatures; null and empty ones are left out."""
    return df.where(F.length(signature) > 0).select(F.col(id_col).alias("id"), F.lower(signature).alias("sig"))


def near_pairs(df: DataFrame, id_col: str, signature: str, most: int) -> DataFrame:
    """(a, b, distance): all pairs of hexadecimal signatures of one length at Hamming distance up to ``most``, a < b."""
    keyed = stage(_keyed(df, id_col, signature), "signatures")
    kinds = stage(keyed.select("sig").distinct(), "signatures")
    both = _near_signatures(kinds, most).union(kinds.select(F.col("sig").alias("s1"), F.col("sig").alias("s2")))
    a, b = keyed.select(F.col("id").alias("i"), F.col("sig").alias("s1")), keyed.select(F.col("id").alias("j"), F.col("sig").alias("s2"))
    pairs = both.join(a, "s1").join(b, "s2").where("s1 <> s2 OR i < j")
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), hamming(F.col("s1"), F.col("s2")).alias("distance"))


def near_edges(df: DataFrame, id_col: str, signature: str, most: int, written: bool = False) -> DataFrame:
    """(a, b): edges with the components of :func:`near_pairs`, without the pairs among equal signatures: each row
    hangs on its signature's first row, and first rows on each other. ``written``: ``df`` costs nothing to read again."""
    keyed = _keyed(df, id_col, signature) if written else stage(_keyed(df, id_col, signature), "signatures")
    heads = stage(keyed.groupBy("sig").agg(F.min("id").alias("head")), "signatures")
    x, y = heads.select(F.col("sig").alias("s1"), F.col("head").alias("a")), heads.select(F.col("sig").alias("s2"), F.col("head").alias("b"))
    between = _near_signatures(heads.select("sig"), most).join(x, "s1").join(y, "s2").select("a", "b")
    return between.union(keyed.join(heads, "sig").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")))


def _staged(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written, and what tells them from others: their number and a sum over them, taken as they are written."""
    seen = Observation()
    e = stage(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
    return e, (seen.get["n"], seen.get["x"])


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): least reachable id. Each round hangs every vertex's larger neighbours on its least one, then
    the smaller ones, until all are stars; a round's edges are staged and the round before is deleted."""
    high, low = F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")
    e, before = _staged(edges.select(high, low).where("u > v").distinct())
    while before[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, after = _staged(others.union(nearest.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        unstage(e)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def near_groups(df: DataFrame, id_col: str, signature: str, path: str, size: str, most: int) -> DataFrame:
    """(group_no, place, id): groups of at least two, numbered by first path from 1; within one the largest first, then path."""
    df = stage(df.select(F.col(id_col).alias("id"), F.col(signature).alias("sig"), F.col(path).alias("_path"), F.col(size).alias("_size")), "signatures")
    comp = connected(near_edges(df, "id", "sig", most, written=True))
    rows = df.select("id", "_path", "_size").join(comp, "id")
    w = Window.partitionBy("component")
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("_size"), "_path")))
    firsts = numbered(rows.groupBy("component").agg(F.min(F.struct("_path", "id")).alias("_first")), ["_first"], "group_no")
    return rows.join(firsts.select("component", F.col("group_no").cast("int").alias("group_no")), "component").select("group_no", "place", "id")
