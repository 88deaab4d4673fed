"""Relational shapes of document processing: first wins, ordered neighbours, walks, islands, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: an aggregate (combined before the shuffle), not a window over whole keys."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(first.alias("_first")).select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def separators(df: DataFrame, unit: list[str], order: list[Column], along: Column, across: Column) -> DataFrame:
    """Adds ``sep``: what is inferred between a row and the one before it in its unit. More than half an em across, or back
    by as much, is a new line; more than 0.15 em along is a space."""
    w = Window.partitionBy(*unit).orderBy(*order)
    first = F.row_number().over(w) == 1
    sep = F.when(first, "").when((F.abs(across) > 0.5) | (along < -0.5), "\n").when(along > 0.15, " ").otherwise("")
    return df.withColumn("sep", sep)


def next_kept(df: DataFrame, unit: list[str], order: list[Column], value: Column, kept: Column, name: str) -> DataFrame:
    """Adds the value of the next row of the unit that is kept."""
    w = Window.partitionBy(*unit).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.first(F.when(kept, value), ignorenulls=True).over(w))


def walk(edges: DataFrame, roots: DataFrame, depth: int = 32) -> DataFrame:
    """(node, root, hops): everything reachable over (parent, child) edges, each node once, by its shortest way.

    One join a level and an anti-join against what was seen, until a level is empty; RuntimeError if that takes more than ``depth``. Levels are
    kept (in memory, else on disk), so that none is computed twice; a lost one is computed again."""
    seen = roots.select(F.col("root").alias("node"), "root", F.lit(0).alias("hops")).dropDuplicates(["node"]).persist()
    level = seen
    for hops in range(1, depth + 2):
        new = level.join(edges, level["node"] == edges["parent"]).groupBy(F.col("child").alias("node")).agg(F.min("root").alias("root"))
        new = new.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hops)).persist()
        if new.isEmpty():
            new.unpersist()
            return seen
        seen, level = seen.unionByName(new), new
    raise RuntimeError(f"the walk goes on beyond {depth} levels")


def islands(df: DataFrame, unit: list[str], value: str, bridge: int = 1) -> DataFrame:
    """(unit..., first, last, n): runs of values; holes of at most ``bridge`` missing values are bridged."""
    w = Window.partitionBy(*unit).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) <= bridge + 1, 0).otherwise(1)
    marked = df.select(*unit, value, new.alias("_new"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*unit, "_island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def within_budget(df: DataFrame, size: Column, tie: Column, need: int, most: int = 200) -> DataFrame:
    """The largest rows (``most`` at most, a feature of the size guard) until their sizes reach ``need``."""
    top = df.withColumn("_size", size).orderBy(F.desc("_size"), tie.desc()).limit(most)
    w = Window.orderBy(F.desc("_size"), tie.desc()).rowsBetween(Window.unboundedPreceding, -1)
    return top.withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0))).where(F.col("_before") < need).drop("_size", "_before")


def missing(needed: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    return needed.join(have, on, "left_anti")


def characters(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, ch): the distinct characters that each group uses; sets are formed per row before any shuffle."""
    each = F.explode(F.array_distinct(F.split(F.col(text), "")))
    return df.select(group, each.alias("ch")).where("ch <> ''").distinct()
