"""Prioritised joins: several ways to find a partner, the first that finds one wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row for each key, the first by the order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def pick_rank(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """All rows that are first by the order."""
    return df.withColumn("_r", F.rank().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def suffixes(name: Column) -> Column:
    """Every dotted suffix of a name: makes a suffix match an equality."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def cascade(calls: DataFrame, steps: list[DataFrame], key: str) -> DataFrame:
    """``steps``: frames ``(key, target, ord)`` in order of trial. Each key's target and step, raw (step 0, no target) if none."""
    tagged = reduce(DataFrame.unionByName, [s.select(key, "target", "ord").withColumn("step", F.lit(i + 1)) for i, s in enumerate(steps)])
    best = pick_first(tagged, [key], "step", "ord", "target").drop("ord")
    return calls.join(best, key, "left").withColumn("step", F.coalesce("step", F.lit(0)))


def placeholders(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, and a placeholder for every edge target that is none."""
    missing = edges.select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return nodes.select("id").withColumn("placeholder", F.lit(False)).unionByName(missing.withColumn("placeholder", F.lit(True)))
