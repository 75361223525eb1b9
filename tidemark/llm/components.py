"""Connected components of an edge table: distributed union-find by stars, on built-in functions.

Each round hangs every vertex's larger neighbours on its smallest neighbour (large star) and
then its smaller ones (small star). Rounds are aggregates and joins on the vertex, so a hub is
pre-aggregated and a skewed join can be split; no adjacency list is ever gathered. A round's
edges are written in the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_table, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v", label: str = "components") -> DataFrame:
    """(id, component): for every vertex with an edge, the smallest vertex it reaches.

    Edges may repeat, point either way or be loops; rows with a null end are no edges. An
    empty table gives an empty one. Ids are compared as longs.
    """
    e = edges.select(F.greatest(F.col(u), F.col(v)).cast("long").alias("u"), F.least(F.col(u), F.col(v)).cast("long").alias("v")).where("u > v").distinct()
    e = materialize(e, label)
    before = _state(e)
    while before[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        new = materialize(small, label)
        after = _state(new)
        drop_table(e.sparkSession, e)
        e = new
        if after == before:
            break
        before = after
    # Stars only: every vertex but the centres has one edge, to its component's smallest vertex.
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
