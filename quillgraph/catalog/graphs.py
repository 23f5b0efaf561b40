"""Graph and tree queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..registry import query

REGIONS = "SELECT DISTINCT src AS root FROM {edge_dag} WHERE src LIKE 'R%'"
TREE = f"""t(root, path, node, depth, circular) AS (SELECT root, [root], root, 0, FALSE FROM ({REGIONS})
    UNION ALL SELECT t.root, list_append(t.path, e.dst), e.dst, t.depth + 1, list_contains(t.path, e.dst) FROM t JOIN (SELECT DISTINCT src, dst FROM {{edge_dag}}) e ON e.src = t.node WHERE NOT t.circular)"""
CYC = """t(root, path, node, depth, circular) AS (SELECT root, [root], root, 0, FALSE FROM (SELECT 'U0' AS root UNION ALL SELECT 'U5')
    UNION ALL SELECT t.root, list_append(t.path, e.dst), e.dst, t.depth + 1, list_contains(t.path, e.dst) FROM t JOIN {edge_cyc} e ON e.src = t.node WHERE NOT t.circular)"""
CLOSURE = "c(src, dst) AS (SELECT src, dst FROM {%s} UNION SELECT c.src, e.dst FROM c JOIN {%s} e ON e.src = c.dst)"
DAG, LOOPS = CLOSURE % ("edge_dag", "edge_dag"), CLOSURE % ("edge_cyc", "edge_cyc")


def roots(get):
    return get.sql(REGIONS)


def two(get):
    return get.spark.createDataFrame([("U0",), ("U5",)], "root string")


def as_rows(tree):
    return tree.select("root", F.array_join("path", ">").alias("path"), "node", "depth", "circular")


@query("call_tree", f"WITH RECURSIVE {TREE} SELECT root, array_to_string(path, '>') AS path, node, depth, circular FROM t")
def _(get):
    return as_rows(G.path_tree(get("edge_dag"), roots(get)))


@query("call_tree_cyclic", f"WITH RECURSIVE {CYC} SELECT root, array_to_string(path, '>') AS path, node, depth, circular FROM t")
def _(get):
    return as_rows(G.path_tree(get("edge_cyc"), two(get)))


@query("caller_tree", """WITH RECURSIVE t(root, path, node, depth) AS (SELECT dst, [dst], dst, 0 FROM (SELECT DISTINCT dst FROM {edge_dag} WHERE starts_with(dst, 'C'))
    UNION ALL SELECT t.root, list_append(t.path, e.src), e.src, t.depth + 1 FROM t JOIN (SELECT DISTINCT src, dst FROM {edge_dag}) e ON e.dst = t.node) SELECT root, array_to_string(path, '>') AS path, depth FROM t""")
def _(get):
    e = get("edge_dag")
    start = e.filter("startswith(dst, 'C')").select(F.col("dst").alias("root")).distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.path_tree(back, start).select("root", F.array_join("path", ">").alias("path"), "depth")


@query("call_tree_stats", f"WITH RECURSIVE {CYC} SELECT root, count(*) FILTER (NOT circular) AS n_nodes, count(*) FILTER (depth > 0) AS n_edges, max(depth) FILTER (NOT circular) AS max_depth FROM t GROUP BY root")
def _(get):
    return G.tree_stats(G.path_tree(get("edge_cyc"), two(get)))


@query("bfs_depth", f"WITH RECURSIVE {TREE} SELECT root, node, min(depth) AS depth FROM t GROUP BY root, node")
def _(get):
    return G.bfs(get("edge_dag"), roots(get))


@query("dep_bfs", f"WITH RECURSIVE {TREE} SELECT root, node, min(depth) AS depth FROM t WHERE depth <= 2 GROUP BY root, node")
def _(get):
    """Only objects of some kinds expand: regions and nations here."""
    return G.bfs(get("edge_dag").filter("startswith(src, 'R') OR startswith(src, 'N')"), roots(get))


@query("transitive_deps", f"WITH RECURSIVE {DAG} SELECT src, dst FROM c")
def _(get):
    return G.closure(get("edge_dag"), max_depth=10).select("src", "dst")


@query("iterative_discovery", f"WITH RECURSIVE {TREE} SELECT depth AS round, count(DISTINCT node) AS n_new FROM t WHERE depth <= 5 GROUP BY depth")
def _(get):
    """New targets by round, five rounds at most."""
    return G.bfs(get("edge_dag"), roots(get), max_depth=5).groupBy(F.col("depth").alias("round")).agg(F.countDistinct("node").alias("n_new"))


@query("descendants", f"WITH RECURSIVE {LOOPS} SELECT src, dst FROM c WHERE src <> dst")
def _(get):
    return G.closure(get("edge_cyc")).filter("src <> dst").select("src", "dst")


FACTS = "SELECT concat('C', CAST(o_custkey AS VARCHAR(20))) AS node, o_orderpriority AS tbl FROM {orders}"


@query("subtree_tables", f"""WITH RECURSIVE {DAG}, f AS ({FACTS}), n AS (SELECT src AS x FROM c UNION SELECT dst FROM c), b AS (SELECT src AS root, dst AS node FROM c WHERE src <> dst UNION ALL SELECT x, x FROM n)
    SELECT root, tbl, count(*) AS n_total, count(*) FILTER (root = b.node) AS n_direct, count(DISTINCT b.node) AS n_nodes FROM b JOIN f ON f.node = b.node GROUP BY root, tbl""")
def _(get):
    return G.subtree_rollup(get("edge_dag"), get.sql(FACTS))


LOC = "SELECT node, CAST(length(node) * 10 AS BIGINT) AS loc FROM (SELECT src AS node FROM {edge_dag} UNION SELECT dst FROM {edge_dag})"


@query("flow_loc", f"""WITH RECURSIVE {DAG}, s AS ({LOC}) SELECT s.node, s.loc, s.loc + coalesce(CAST(sum(d.loc) AS BIGINT), 0) AS flow_loc, count(d.node) AS n_below
    FROM s LEFT JOIN c ON c.src = s.node AND c.src <> c.dst LEFT JOIN s d ON d.node = c.dst GROUP BY s.node, s.loc""")
def _(get):
    return G.subtree_sum(get("edge_dag"), get.sql(LOC))


@query("in_cycle", f"WITH RECURSIVE {LOOPS} SELECT src AS node FROM c WHERE src = dst")
def _(get):
    return G.in_cycle(get("edge_cyc"))


@query("scc", f"""WITH RECURSIVE {LOOPS}, n AS (SELECT src AS node FROM c UNION SELECT dst FROM c) SELECT node, least(node, coalesce((SELECT min(a.dst) FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src = n.node), node)) AS comp FROM n""")
def _(get):
    return G.strong_components(get("edge_cyc"))


@query("edge_in_scc", f"WITH RECURSIVE {LOOPS} SELECT src, dst, EXISTS (SELECT 1 FROM c WHERE c.src = e.dst AND c.dst = e.src) AS back FROM {{edge_cyc}} e")
def _(get):
    return G.edges_in_components(get("edge_cyc"))


@query("first_caller", "SELECT dst AS node, arg_min(src, ord) AS parent FROM {edge_dag} GROUP BY dst")
def _(get):
    return get("edge_dag").groupBy(F.col("dst").alias("node")).agg(F.min_by("src", "ord").alias("parent"))


@query("bounded_tree", f"""WITH RECURSIVE k AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS p FROM {{edge_dag}}) WHERE p <= 3),
    t(root, path, node, depth) AS (SELECT root, [root], root, 0 FROM ({REGIONS}) UNION ALL SELECT t.root, list_append(t.path, k.dst), k.dst, t.depth + 1 FROM t JOIN k ON k.src = t.node WHERE t.depth < 3)
    SELECT root, array_to_string(path, '>') AS path, depth FROM t""")
def _(get):
    """Three children of each node at most, three levels."""
    return G.path_tree(get("edge_dag"), roots(get), max_depth=3, max_children=3, max_nodes=2000).select("root", F.array_join("path", ">").alias("path"), "depth")


EVIDENCE = "SELECT concat('O', CAST(o_orderkey AS VARCHAR(20))) AS node, CASE o_orderstatus WHEN 'F' THEN 'READ' WHEN 'O' THEN 'WRITE' ELSE 'COUNT' END AS op FROM {orders} UNION ALL SELECT concat('N', CAST(n_nationkey AS VARCHAR(20))), 'DELETE' FROM {nation} WHERE n_nationkey % 5 = 0"


@query("op_propagate", f"""WITH RECURSIVE ev AS ({EVIDENCE}), p(node, op) AS (SELECT node, op FROM ev UNION SELECT e.src, p.op FROM p JOIN {{edge_dag}} e ON e.dst = p.node WHERE e.src NOT IN (SELECT node FROM ev))
    SELECT node, arg_max(op, CASE op WHEN 'COUNT' THEN 1 WHEN 'READ' THEN 3 WHEN 'DELETE' THEN 4 WHEN 'WRITE' THEN 6 END) AS op FROM p GROUP BY node""")
def _(get):
    return G.propagate(get("edge_dag"), get.sql(EVIDENCE))


@query("tree_flatten", f"""WITH RECURSIVE k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS p FROM {{edge_dag}}),
    t(root, places, node, depth) AS (SELECT root, CAST([] AS BIGINT[]), root, 0 FROM ({REGIONS}) UNION ALL SELECT t.root, list_append(t.places, k.p), k.dst, t.depth + 1 FROM t JOIN k ON k.src = t.node)
    SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY places) AS INTEGER) AS n, node, depth, (SELECT count(*) FROM k WHERE k.src = t.node) AS n_children FROM t""")
def _(get):
    return G.flatten(G.path_tree(get("edge_dag"), roots(get)))


@query("breadcrumb", f"WITH RECURSIVE {TREE} SELECT root, array_to_string(CASE WHEN len(path) > 2 THEN path[-2:] ELSE path END, ' / ') AS crumb, depth FROM t")
def _(get):
    """The last segments of a path."""
    t = G.path_tree(get("edge_dag"), roots(get))
    return t.select("root", F.array_join(F.when(F.size("path") > 2, F.slice("path", -2, 2)).otherwise(F.col("path")), " / ").alias("crumb"), "depth")


@query("cross_module", f"WITH RECURSIVE {TREE} SELECT root, node, path[2] IS DISTINCT FROM (CASE WHEN depth > 1 THEN path[3] END) AS crosses, depth FROM t")
def _(get):
    """Whether a node's module differs from another's, nulls being equal."""
    t = G.path_tree(get("edge_dag"), roots(get))
    return t.select("root", "node", (~F.get("path", F.lit(1)).eqNullSafe(F.when(F.col("depth") > 1, F.get("path", F.lit(2))))).alias("crosses"), "depth")


@query("impl_closure", f"WITH RECURSIVE {LOOPS} SELECT src AS type, count(*) AS n_impl FROM c GROUP BY src")
def _(get):
    return G.closure(get("edge_cyc")).groupBy(F.col("src").alias("type")).agg(F.count("*").alias("n_impl"))


@query("count_nodes", f"WITH RECURSIVE {TREE} SELECT root, count(*) AS n FROM t GROUP BY root")
def _(get):
    return G.path_tree(get("edge_dag"), roots(get)).groupBy("root").agg(F.count("*").alias("n"))


@query("graph_objects", "SELECT node, starts_with(node, 'N') AS expands FROM (SELECT src AS node FROM {edge_dag} UNION SELECT dst FROM {edge_dag})")
def _(get):
    return G.objects(get("edge_dag"), "N")


@query("reverse_refs", "SELECT src FROM {edge_dag} WHERE dst = 'C10' ORDER BY src")
def _(get):
    return get("edge_dag").filter("dst = 'C10'").select("src").orderBy("src")


@query("connect_by_nocycle", f"WITH RECURSIVE {CYC} SELECT DISTINCT node, depth + 1 AS level, path[1] AS connect_root FROM t WHERE NOT circular AND depth < 10")
def _(get):
    """START WITH ... CONNECT BY NOCYCLE PRIOR, with LEVEL and CONNECT_BY_ROOT."""
    from ..plans.dialect import connect_by

    return connect_by(get("edge_cyc"), two(get), max_level=10).select("node", "level", "connect_root").distinct()
