"""Duplicates, dominant values, ranks, samples, trees, common prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_duplicates(df: DataFrame, digest: str, id_col: str, order: list[Column]) -> DataFrame:
    """``dup_of``: the id of the best row (by ``order``, then id) of the same digest; null for it, for single rows and null digests."""
    best = df.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("_d")).agg(F.min_by(id_col, F.struct(*order, F.col(id_col))).alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    joined = df.join(best, F.col(digest) == F.col("_d"), "left")
    return joined.withColumn("dup_of", F.when(F.col("_best") != F.col(id_col), F.col("_best"))).drop("_d", "_best", "_n")


def canonical_order(strategy: str, source: Column, size: Column) -> list[Column]:
    larger = -F.coalesce(size, F.lit(0))
    return [(~source.eqNullSafe("exif")).cast("int").alias("a"), larger.alias("b")] if strategy == "prefer_exif_then_largest" else [larger.alias("b")]


def dominant(df: DataFrame, keys: list[str], value: str, order: list[str], out: str = "dominant") -> DataFrame:
    """Per key the most frequent value; ties go to the value seen first by ``order``. Null values do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(out), F.max("_n").alias("n_dominant"), F.count("*").alias("n_values"))


def best_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def quality_order(width: Column, height: Column, size: Column, id_col: Column) -> list[Column]:
    return [F.coalesce(width * height, F.lit(0)).desc(), F.coalesce(size, F.lit(0)).desc(), id_col.asc()]


def even_samples(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` evenly spaced rows per group: positions round(i (n-1) / (most-1)), halves to even; one row: the first."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    if most <= 1:
        return d.where("_i = 0").drop("_i", "_n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(most - 1)).cast("int"))
    return d.where((F.col("_n") <= most) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def tree_counts(df: DataFrame, path: str, sep: str = "/") -> DataFrame:
    """(prefix, depth, n): rows at and below each prefix of the path."""
    parts = F.split(F.col(path), sep)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), d), sep).alias("prefix"), d.alias("depth")))
    return df.select(F.explode(prefixes).alias("p")).groupBy("p.prefix", "p.depth").agg(F.count("*").alias("n"))


def common_prefix(df: DataFrame, path: str, sep: str = "/") -> DataFrame:
    """The longest common path: that of the smallest and the largest array of segments."""
    ends = df.select(F.split(path, sep).alias("p")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    k = F.aggregate(
        F.sequence(F.lit(0), F.least(F.size("lo"), F.size("hi")) - 1), F.lit(0), lambda a, i: F.when((a == i) & (F.get("lo", i) == F.get("hi", i)), a + 1).otherwise(a)
    )
    return ends.select(F.array_join(F.slice("lo", F.lit(1), k), sep).alias("common"))


def histogram(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def floor_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(0).cast("long")


def coverage(files: DataFrame) -> DataFrame:
    """One pass over ``files``: totals and whole percents. The total leaves errors out, the parts do not."""
    n = lambda c: F.count(F.when(c, 1))
    total = n(F.col("error").isNull())
    parts = {"with_gps": F.col("gps_lat").isNotNull(), "exif": F.col("taken_at_source") == "exif", "filename": F.col("taken_at_source") == "filename", "mtime": F.col("taken_at_source") == "mtime", "dups": F.col("dup_of").isNotNull(), "errors": F.col("error").isNotNull()}
    out = [total.alias("total")]
    for name, c in parts.items():
        out += [n(c).alias(name), floor_percent(n(c), total).alias(f"{name}_pct")]
    return files.agg(*out)


def carry_over(old: DataFrame, new: DataFrame, member: str, share_of: str = "old", at_least: float = 0.5) -> DataFrame:
    """(new_group, old_group, overlap): which new group takes over which old one.

    ``old``: (old_group, member), ``new``: (new_group, member). The overlap must be more than
    ``at_least`` of the ``share_of`` group; of several old groups the largest overlap wins, then the smallest id.
    """
    both = old.join(new, member).groupBy("new_group", "old_group").agg(F.count("*").alias("overlap"))
    sizes = (old if share_of == "old" else new).groupBy(f"{share_of}_group").agg(F.count("*").alias("_size"))
    good = both.join(sizes, f"{share_of}_group").where(F.col("overlap") > at_least * F.col("_size"))
    return best_per_group(good, ["new_group"], [F.desc("overlap"), F.asc("old_group")]).select("new_group", "old_group", "overlap")


def numbered(df: DataFrame, order: list[str], out: str = "number", base: int = 0) -> DataFrame:
    """``out``: the row's number by ``order`` from ``base`` + 1, without one partition that holds all rows.

    Rows are dealt by ranges of ``order`` and written once, so that numbers do not change if a task is
    repeated; the ranges' counts, a row each, tell where each one starts. Rows alike in ``order`` get
    different numbers, in any order among them.
    """
    from tidemark.sources.tables import stage

    dealt = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    line = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_at", within).join(starts, "_range").withColumn(out, F.lit(base) + F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")
