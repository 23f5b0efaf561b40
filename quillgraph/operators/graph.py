"""Graph operators over ``edges(src, dst, ...)``: frontier loops whose every level is a join and an anti join.

Reachability is the true one (a node reaches itself only through a cycle). Loops end when a level adds nothing. Levels are
stored in the shared folder, so a plan never grows with the depth.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.classify import ROLL_UP_PRIORITY, rank_of
from ..plans.lineage import cut


def bfs(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``root, node, depth``: least number of edges from each ``roots(root)``; a root is at depth 0. ``max_depth`` is a limit of the caller's."""
    edges = edges.select("src", "dst").distinct()
    seen = frontier = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)).select("root", "node", "depth"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier)) if depth % 16 == 0 else seen.unionByName(frontier)
    return seen


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``src, dst, depth``: pairs that a path of one edge or more joins (of ``max_depth`` at most, if given), with its least length."""
    edges = edges.select("src", "dst").distinct()
    seen = frontier = cut(edges.withColumn("depth", F.lit(1)))
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        frontier = cut(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier)) if depth % 16 == 0 else seen.unionByName(frontier)
    return seen


def path_tree(edges: DataFrame, roots: DataFrame, max_depth: int = 50, max_children: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """``root, path, node, depth, circular``: every path from a root. A node that is on its own path is a circular leaf.

    ``edges`` may have ``ord`` for the order of children; ``max_children`` and ``max_nodes`` are the tree's own limits, by that order.
    """
    order = ["ord", "dst"] if "ord" in edges.columns else ["dst"]
    children = edges.groupBy("src", "dst").agg(F.min("ord").alias("ord")) if "ord" in edges.columns else edges.select("src", "dst").distinct()
    ranked = children.withColumn("pos", F.row_number().over(W.partitionBy("src").orderBy(*order)))
    if max_children:
        ranked = ranked.filter(F.col("pos") <= max_children)
    level = cut(roots.select("root", F.array("root").alias("path"), F.array().cast("array<int>").alias("places"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("circular")))
    out = level
    for depth in range(1, max_depth + 1):
        open_ = level.filter("not circular").select("root", "path", "places", F.col("node").alias("src"))
        level = cut(open_.join(ranked, "src").select(
            "root", F.concat("path", F.array("dst")).alias("path"), F.concat("places", F.array("pos")).alias("places"), F.col("dst").alias("node"),
            F.lit(depth).alias("depth"), F.array_contains("path", F.col("dst")).alias("circular"),
        ))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    if max_nodes:
        out = out.withColumn("n", F.row_number().over(W.partitionBy("root").orderBy("places"))).filter(F.col("n") <= max_nodes).drop("n")
    return out


def tree_stats(tree: DataFrame) -> DataFrame:
    """Nodes and edges as path instances: a circular leaf is no node, the edge to it counts."""
    return tree.groupBy("root").agg(F.count_if(~F.col("circular")).alias("n_nodes"), F.count_if(F.col("depth") > 0).alias("n_edges"), F.max(F.when(~F.col("circular"), F.col("depth"))).alias("max_depth"))


def flatten(tree: DataFrame) -> DataFrame:
    """Pre-order number of every tree row, with its number of children."""
    kids = tree.filter("depth > 0").groupBy("root", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.count("*").alias("n_children"))
    numbered = tree.withColumn("n", F.row_number().over(W.partitionBy("root").orderBy("places")))
    return numbered.join(kids, ["root", "path"], "left").select("root", "n", "node", "depth", F.when(F.col("circular"), 0).otherwise(F.coalesce("n_children", F.lit(0))).alias("n_children"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """``src, dst`` without what no cycle can hold: edges from a node that none leads to, or to one that leads nowhere, again and again."""
    left = cut(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        left, before = cut(kept), n
        n = left.count()
        if n == before:
            break
    return left


def in_cycle(edges: DataFrame) -> DataFrame:
    """``node`` that reaches itself. Only the cyclic core is closed."""
    return closure(cyclic_core(edges)).filter("src = dst").select(F.col("src").alias("node"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, comp``: comp is the least node of those that reach each other. Only the cyclic core is closed."""
    c = closure(cyclic_core(edges)).select("src", "dst")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    mutual = c.join(c.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    low = mutual.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
    return nodes.join(low, "node", "left").select("node", F.least("node", F.coalesce("low", "node")).alias("comp"))


def edges_in_components(edges: DataFrame) -> DataFrame:
    """``src, dst, back``: whether the edge is inside a strong component."""
    s = strong_components(edges)
    e = edges.select("src", "dst").distinct()
    both = e.join(s.select(F.col("node").alias("src"), F.col("comp").alias("a")), "src").join(s.select(F.col("node").alias("dst"), F.col("comp").alias("b")), "dst")
    return both.select("src", "dst", (F.col("a") == F.col("b")).alias("back"))


def subtree_rollup(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts(node, tbl)`` of a node and of all it reaches: ``node, tbl, n_total, n_direct, n_nodes``."""
    below = closure(edges).filter("src <> dst").select(F.col("src").alias("root"), F.col("dst").alias("node"))
    nodes = edges.select(F.col("src").alias("root")).union(edges.select("dst")).distinct()
    both = below.unionByName(nodes.select("root", F.col("root").alias("node"))).join(facts, "node")
    return both.groupBy("root", "tbl").agg(F.count("*").alias("n_total"), F.count_if(F.col("root") == F.col("node")).alias("n_direct"), F.countDistinct("node").alias("n_nodes"))


def subtree_sum(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """``sizes(node, loc)``: own, with all descendants, and how many."""
    below = closure(edges).filter("src <> dst").select(F.col("src").alias("root"), F.col("dst").alias("node"))
    down = below.join(sizes, "node").groupBy(F.col("root").alias("node")).agg(F.sum("loc").alias("below"), F.count("*").alias("n_below"))
    return sizes.join(down, "node", "left").select("node", "loc", (F.col("loc") + F.coalesce("below", F.lit(0))).alias("flow_loc"), F.coalesce("n_below", F.lit(0)).alias("n_below"))


def propagate(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """``evidence(node, op)``: a node with evidence keeps its best operation; another takes the best of its children's, upwards."""
    best = lambda g: g.agg(F.max_by("op", rank_of(F.col("op"), ROLL_UP_PRIORITY)).alias("op"))
    own = cut(best(evidence.groupBy("node")))
    up = edges.select(F.col("dst").alias("node"), F.col("src").alias("parent")).distinct().join(own.select(F.col("node").alias("parent")), "parent", "left_anti")
    seen = frontier = own
    while True:
        step = frontier.join(up, "node").select(F.col("parent").alias("node"), "op").distinct()
        frontier = cut(step.join(seen, ["node", "op"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return best(seen.groupBy("node"))


def objects(edges: DataFrame, prefix: str) -> DataFrame:
    """All nodes, and whether they are of the kind that a prefix marks."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.select("node", F.col("node").startswith(prefix).alias("expands"))
