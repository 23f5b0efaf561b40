"""Connected components of an undirected graph of links, by alternating large and small stars.

Every round is two aggregations and two joins over the links; nothing is collected. Rounds end as soon as the links are stars. Each
round's links are a table in the shared folder, so that lost executors cost one round at most. A node with more than one in ``HUBS`` of all links would put them all
into one task of a join; there are at most 4 * HUBS such nodes, so their minimum goes out by broadcast and their links stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop_table, stored

HUBS = 1000


def _left(edges: DataFrame) -> tuple[int, bool]:
    """How many ``edges(u, v)``, v below u, there are, and whether they are stars around their least nodes: no u has two v, no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    r = nodes.agg(F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("bad")).first()
    return r["n"] or 0, not r["bad"]


def _with_least(links: DataFrame, n: int) -> DataFrame:
    """``links(u, v)`` with ``m``, the least ``v`` of each ``u``; more than ``n`` in HUBS links make a hub."""
    low = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    hubs = low.filter(F.col("_n") * HUBS > n).select("u", "m")
    tagged = links.join(F.broadcast(hubs.withColumnRenamed("m", "hub")), "u", "left")
    rest = tagged.filter("hub is null").select("u", "v").join(low.filter(F.col("_n") * HUBS <= n).select("u", "m"), "u")
    return rest.unionByName(tagged.filter("hub is not null").select("u", "v", F.col("hub").alias("m")))


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links(a, b)``: comp is the smallest node that can be reached. Stored. A link of a node to itself
    says nothing; no links, no rows."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    n, done = _left(edges)
    while not done:
        n = 1 << (n.bit_length() - 1)  # a power of two, so that rounds share their generated code; hubs are at most twice as many by that
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large, n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = stored(small.filter("u <> v").distinct(), "links")
        drop_table(edges)
        edges = new
        n, done = _left(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    out = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots), "components")
    drop_table(edges)
    return out
