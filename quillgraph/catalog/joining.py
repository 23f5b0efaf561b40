"""Joins over facts, with the order of trial where there are several ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dispatch
from ..operators import resolve as R
from ..operators import similar
from ..registry import query

NODES = "SELECT concat('S', CAST(p_size % 3 AS VARCHAR(9)), '.', p_type, '.', replace(p_name, ' ', '_')) AS id, min(p_partkey) AS ord FROM {part} GROUP BY 1"
CALLS = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN concat('S', CAST(p_size % 3 AS VARCHAR(9)), '.', p_type, '.', replace(p_name, ' ', '_')) WHEN 1 THEN concat(p_type, '.', replace(p_name, ' ', '_')) WHEN 2 THEN replace(p_name, ' ', '_') ELSE concat('zz.', p_name) END AS name, concat('S', CAST(p_size % 2 AS VARCHAR(9))) AS caller_schema FROM {part}"


@query("resolve_cascade", f"""WITH nodes AS ({NODES}), calls AS ({CALLS}), m AS (
    SELECT k, id AS target, ord, 1 AS step FROM calls JOIN nodes ON id = name UNION ALL SELECT k, id, ord, 2 FROM calls JOIN nodes ON id = concat(caller_schema, '.', name)
    UNION ALL SELECT k, id, ord, 3 FROM calls JOIN nodes ON ends_with(id, concat('.', name)))
    SELECT calls.k, name, target, coalesce(step, 0) AS step FROM calls LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY step, ord, target) AS n FROM m) WHERE n = 1) b ON b.k = calls.k""")
def _(get):
    """Exact id, then with the caller's schema, then any id that ends in the name (an equality on cut suffixes)."""
    nodes, calls = get.sql(NODES), get.sql(CALLS)
    tails = nodes.select("id", "ord", F.explode(R.suffixes(F.col("id"))).alias("tail")).filter("tail <> id")
    steps = [
        calls.join(nodes, calls["name"] == nodes["id"]).select("k", F.col("id").alias("target"), "ord"),
        calls.join(nodes, F.concat_ws(".", "caller_schema", "name") == nodes["id"]).select("k", F.col("id").alias("target"), "ord"),
        calls.join(tails, calls["name"] == tails["tail"]).select("k", F.col("id").alias("target"), "ord"),
    ]
    return R.cascade(calls, steps, "k").select("k", "name", "target", "step")


@query("edge_node_match", "SELECT e.src, e.dst, n.n_name AS name FROM {edge_dag} e LEFT JOIN nation n ON concat('N', CAST(n.n_nationkey AS VARCHAR)) = e.dst")
def _(get):
    n = get("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("dst"), F.col("n_name").alias("name"))
    return get("edge_dag").select("src", "dst").join(n, "dst", "left").select("src", "dst", "name")


@query("schema_resolve", """SELECT name, coalesce(a, b, c, 'UNKNOWN') AS owner FROM (SELECT DISTINCT concat(p_type, '_', p_brand) AS name FROM part)
    LEFT JOIN (SELECT name, min(owner) AS a FROM {dict_objects} WHERE owner = 'OWN2' GROUP BY name) USING (name) LEFT JOIN (SELECT name, min(owner) AS b FROM {dict_objects} WHERE type = 'TABLE' GROUP BY name) USING (name)
    LEFT JOIN (SELECT name, min(owner) AS c FROM {dict_objects} WHERE owner <> 'OWN0' GROUP BY name) USING (name)""")
def _(get):
    """Preferred schema, then by type, then bare; one pass over the dictionary instead of a join for each level."""
    d = get("dict_objects")
    low = lambda cond: F.min(F.when(cond, F.col("owner")))
    g = d.groupBy("name").agg(low(F.col("owner") == "OWN2").alias("a"), low(F.col("type") == "TABLE").alias("b"), low(F.col("owner") != "OWN0").alias("c"))
    return g.select("name", F.coalesce("a", "b", "c", F.lit("UNKNOWN")).alias("owner"))


@query("cursor_table_antijoin", "SELECT DISTINCT tbl FROM {access} a WHERE op = 'SELECT' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 40 AND p_type = 'PROMO' AND p_brand LIKE 'Brand#1%') p WHERE p.p_brand = a.tbl)")
def _(get):
    known = get("part").filter("p_size < 40 AND p_type = 'PROMO' AND p_brand LIKE 'Brand#1%'").select(F.col("p_brand").alias("tbl"))
    return get("access").filter("op = 'SELECT'").select("tbl").distinct().join(known, "tbl", "left_anti")


@query("trigger_attach", """SELECT s_name AS trig, tbl FROM (SELECT s_name, s_suppkey, concat('Brand#', CAST(s_nationkey AS VARCHAR)) AS t FROM supplier) LEFT JOIN (SELECT DISTINCT p_brand AS tbl FROM part) ON upper(tbl) = upper(t)""")
def _(get):
    trig = get("supplier").select(F.col("s_name").alias("trig"), F.upper(F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string"))).alias("k"))
    tabs = get("part").groupBy(F.upper("p_brand").alias("k")).agg(F.min("p_brand").alias("tbl"))
    return trig.join(tabs, "k", "left").select("trig", "tbl")


HIER = "WITH RECURSIVE h(base, sub, depth) AS (SELECT src, dst, 1 FROM {edge_dag} UNION ALL SELECT h.base, e.dst, h.depth + 1 FROM h JOIN {edge_dag} e ON e.src = h.sub)"


@query("dispatch_expand", HIER + " SELECT base, count(*) AS n_impl, min(depth) AS nearest FROM h WHERE starts_with(sub, 'C') GROUP BY base")
def _(get):
    """Interfaces to implementations at any depth, the nearest named."""
    from ..operators.graph import closure

    return closure(get("edge_dag")).filter("startswith(dst, 'C')").groupBy(F.col("src").alias("base")).agg(F.count("*").alias("n_impl"), F.min("depth").alias("nearest"))


IMPLS = """SELECT concat('I', CAST(s_nationkey AS VARCHAR(9))) AS iface, concat('app.p', CAST(s_suppkey % 3 AS VARCHAR(9)), '.Svc', CAST(s_suppkey AS VARCHAR(9))) AS impl, concat('Svc', CAST(s_suppkey AS VARCHAR(9))) AS simple,
    s_suppkey % 4 = 1 AS primary, s_suppkey AS ord FROM {supplier}"""
BEANS = "SELECT concat('bean', CAST(s_suppkey % 10 AS VARCHAR(9))) AS name, concat('app.p', CAST(min(s_suppkey) % 3 AS VARCHAR(9)), '.Svc', CAST(min(s_suppkey) AS VARCHAR(9))) AS bean FROM {supplier} GROUP BY 1"
ASKED = """SELECT c_custkey AS k, concat('I', CAST(c_nationkey AS VARCHAR(9))) AS iface, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('mySvc', CAST(c_custkey % 100 AS VARCHAR(9))) WHEN 2 THEN 'svc' WHEN 3 THEN concat('bean', CAST(c_custkey % 10 AS VARCHAR(9))) ELSE 'other' END AS field,
    CASE c_custkey % 7 WHEN 0 THEN concat('svc', CAST(c_custkey % 100 AS VARCHAR(9))) WHEN 1 THEN concat('bean', CAST(c_custkey % 10 AS VARCHAR(9))) WHEN 2 THEN concat('VC', CAST(c_custkey % 100 AS VARCHAR(9))) WHEN 3 THEN concat('Svc', CAST(c_custkey % 100 AS VARCHAR(9))) END AS qualifier FROM {customer}"""


@query("dispatch_narrow", f"""WITH i AS ({IMPLS}), b AS ({BEANS}), c AS ({ASKED}), m AS (
    SELECT k, impl, ord, 1 AS rule FROM c JOIN i USING (iface) WHERE field IS NOT NULL AND (qualifier = concat(lower(simple[1]), simple[2:]) OR ends_with(impl, concat('.', qualifier)))
    UNION ALL SELECT k, impl, ord, 2 FROM c JOIN i USING (iface) JOIN b ON b.name = qualifier AND b.bean = impl WHERE field IS NOT NULL
    UNION ALL SELECT k, impl, ord, 3 FROM c JOIN i USING (iface) WHERE field IS NOT NULL AND (contains(lower(simple), lower(qualifier)) OR ends_with(lower(impl), concat('.', lower(qualifier))))
    UNION ALL SELECT k, impl, ord, 4 FROM c JOIN i USING (iface) WHERE length(field) > 3 AND (contains(lower(simple), lower(field)) OR contains(lower(field), lower(simple)))
    UNION ALL SELECT k, impl, ord, 5 FROM c JOIN i USING (iface) JOIN b ON b.name = field AND b.bean = impl
    UNION ALL SELECT k, impl, ord, 6 FROM c JOIN i USING (iface) WHERE i.primary AND (SELECT count(*) FROM i x WHERE x.iface = c.iface AND x.primary) = 1)
    SELECT c.k, impl, rule, CASE rule WHEN 4 THEN 'HEURISTIC' WHEN 6 THEN 'PRIMARY' WHEN NULL THEN NULL ELSE CASE WHEN rule IS NOT NULL THEN 'QUALIFIED' END END AS how
    FROM c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rule, ord, impl) AS n FROM m) WHERE n = 1) t ON t.k = c.k""")
def _(get):
    """Calls through an interface to one implementation, by six rules in order."""
    return dispatch.narrow(get.sql(ASKED), get.sql(IMPLS), get.sql(BEANS))


CLASSES = "SELECT concat('K', CAST(p_partkey AS VARCHAR(20))) AS src, concat('K', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20))) AS dst FROM {part} WHERE p_partkey > 1"
METHODS = "SELECT concat('K', CAST(p_partkey AS VARCHAR(20))) AS owner, concat('m', CAST(p_partkey % 9 AS VARCHAR(9))) AS method FROM {part}"
INVOKED = "SELECT DISTINCT concat('K', CAST(p_partkey AS VARCHAR(20))) AS cls, concat('m', CAST(p_size % 10 AS VARCHAR(9))) AS method FROM {part}"


@query("method_owner", f"""WITH RECURSIVE c AS ({CLASSES}), m AS ({METHODS}), q AS ({INVOKED}), u(cls, node, up) AS (SELECT DISTINCT cls, cls, 0 FROM q UNION ALL SELECT u.cls, c.dst, u.up + 1 FROM u JOIN c ON c.src = u.node)
    SELECT q.cls, q.method, f.owner, f.up FROM q LEFT JOIN (SELECT u.cls, m.method, arg_min(m.owner, u.up) AS owner, min(u.up) AS up FROM u JOIN m ON m.owner = u.node GROUP BY u.cls, m.method) f ON f.cls = q.cls AND f.method = q.method""")
def _(get):
    """The class up the superclass chain that declares a called method."""
    return dispatch.declared_by(get.sql(INVOKED), get.sql(CLASSES), get.sql(METHODS))


@query("event_connect", """WITH RECURSIVE s(sub, base) AS (SELECT DISTINCT dst, src FROM {edge_cyc} UNION SELECT s.sub, e.src FROM s JOIN {edge_cyc} e ON e.dst = s.base),
    k AS (SELECT sub, base FROM s UNION SELECT sub, sub FROM s) SELECT concat('P', CAST(user_id AS VARCHAR)) AS publisher, base AS listener, count(*) AS n FROM events JOIN k ON k.sub = concat('U', CAST(user_id % 15 AS VARCHAR)) WHERE event_type = 'purchase' GROUP BY 1, 2""")
def _(get):
    """Publishers to listeners of the event's type or a supertype."""
    from ..operators.graph import closure

    up = closure(get("edge_cyc").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("src").alias("sub"), F.col("dst").alias("base"))
    own = up.select("sub", F.col("sub").alias("base"))
    hier = up.union(own).distinct()
    e = get("events").filter("event_type = 'purchase'").select(F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("publisher"), F.concat(F.lit("U"), (F.col("user_id") % 15).cast("string")).alias("sub"))
    return e.join(hier, "sub").groupBy("publisher", F.col("base").alias("listener")).agg(F.count("*").alias("n"))


@query("correction_apply", """WITH corr AS (SELECT n_nationkey AS id, concat('COLL_', CAST(n_nationkey AS VARCHAR)) AS exact, r_name AS dom FROM nation JOIN region ON r_regionkey = n_regionkey),
    m AS (SELECT DISTINCT id, collection, 1 AS rule FROM corr JOIN {usage} ON collection = exact AND op = 'READ' UNION ALL SELECT DISTINCT id, collection, 2 FROM corr JOIN {usage} ON domain = dom AND op = 'WRITE')
    SELECT id, collection, rule FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY rule) AS r FROM m) WHERE r = 1""")
def _(get):
    """A correction goes to all matches of the first rule that has any."""
    corr = get("nation").join(get("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("id"), F.concat(F.lit("COLL_"), F.col("n_nationkey").cast("string")).alias("exact"), F.col("r_name").alias("dom"))
    u = get("usage")
    one = corr.join(u.filter("op = 'READ'").select("collection").distinct(), F.col("collection") == F.col("exact")).select("id", "collection", F.lit(1).alias("rule"))
    two = corr.join(u.filter("op = 'WRITE'").select("collection", "domain").distinct(), F.col("domain") == F.col("dom")).select("id", "collection", F.lit(2).alias("rule"))
    return R.pick_rank(one.unionByName(two), ["id"], "rule")


@query("repo_entity", """SELECT n.n_name AS repo, coalesce(d.r_name, s.r_name) AS entity FROM nation n LEFT JOIN region d ON d.r_regionkey = n.n_regionkey AND n.n_nationkey % 2 = 0 LEFT JOIN region s ON starts_with(n.n_name, substring(s.r_name, 1, 1)) AND s.r_regionkey = (SELECT min(r_regionkey) FROM region x WHERE starts_with(n.n_name, substring(x.r_name, 1, 1)))""")
def _(get):
    """The entity by type, else by the stem of the name."""
    n, r = get("nation"), get("region")
    stem = r.groupBy(F.substring("r_name", 1, 1).alias("stem")).agg(F.min_by("r_name", "r_regionkey").alias("by_stem"))
    typed = n.withColumn("k", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey"))).join(r, F.col("k") == F.col("r_regionkey"), "left")
    return typed.join(stem, F.substring("n_name", 1, 1) == F.col("stem"), "left").select(F.col("n_name").alias("repo"), F.coalesce("r_name", "by_stem").alias("entity"))


IMPLICIT = "(VALUES ('view', 'VIEW_LOG'), ('purchase', 'ORDER_LOG')) AS i(callee, collection)"


@query("implicit_lookup", f"SELECT caller, collection, count(*) AS n FROM {{call}} JOIN {IMPLICIT} USING (callee) GROUP BY caller, collection")
def _(get):
    table = get.spark.sql(f"SELECT * FROM {IMPLICIT}")  # configuration: its size is fixed
    return get("call").join(F.broadcast(table), "callee").groupBy("caller", "collection").agg(F.count("*").alias("n"))


@query("named_query", "SELECT c.ord, t.sql FROM {call} c JOIN {sql_text} t ON t.id = c.line")
def _(get):
    t = get("sql_text").select(F.col("id").alias("line"), "sql")
    return get("call").join(t, "line").select("ord", "sql")


@query("placeholder_union", "SELECT id, FALSE AS placeholder FROM (SELECT DISTINCT src AS id FROM {edge_dag}) UNION ALL SELECT DISTINCT dst, TRUE FROM {edge_dag} WHERE dst NOT IN (SELECT src FROM {edge_dag})")
def _(get):
    e = get("edge_dag")
    return R.placeholders(e, e.select(F.col("src").alias("id")).distinct())


W = "SELECT dep, greatest(0.1, ln((SELECT count(DISTINCT id) FROM {fingerprint}) / count(*))) * CASE WHEN starts_with(dep, 'coll:') THEN 2.0 WHEN starts_with(dep, 'domain:') THEN 1.5 ELSE 1.0 END AS weight FROM {fingerprint} GROUP BY dep"


@query("idf_weight", f"SELECT dep, round(weight, 6) AS weight FROM ({W})")
def _(get):
    return similar.idf_weights(get("fingerprint")).select("dep", F.round("weight", 6).alias("weight"))


JACCARD = f"""w AS ({W}), f AS (SELECT id, dep, weight FROM {{fingerprint}} JOIN w USING (dep)), t AS (SELECT id, sum(weight) AS t FROM f GROUP BY id),
    s AS (SELECT x.id AS a, y.id AS b, sum(x.weight) AS s FROM f x JOIN f y ON x.dep = y.dep AND x.id < y.id GROUP BY 1, 2), sc AS (SELECT a, b, round(s / (p.t + q.t - s), 6) AS score FROM s JOIN t p ON p.id = a JOIN t q ON q.id = b)"""


@query("weighted_jaccard", f"WITH {JACCARD} SELECT a, b, score FROM sc")
def _(get):
    f = get("fingerprint")
    return similar.weighted_jaccard(f, similar.idf_weights(f))


@query("cluster_cohesion", f"""WITH {JACCARD}, m AS (SELECT id, CAST(substring(id, 2, 9) AS INT) % 12 AS cluster FROM t), z AS (SELECT cluster, count(*) AS n FROM m GROUP BY cluster)
    SELECT z.cluster, n, CASE WHEN n = 1 THEN 1.0 ELSE round(coalesce(sum(score), 0.0) / (n * (n - 1) / 2), 6) END AS cohesion FROM z LEFT JOIN (SELECT x.cluster, score FROM sc JOIN m x ON x.id = a JOIN m y ON y.id = b AND y.cluster = x.cluster) p ON p.cluster = z.cluster GROUP BY z.cluster, n""")
def _(get):
    f = get("fingerprint")
    members = f.select("id").distinct().withColumn("cluster", F.substring("id", 2, 9).cast("int") % 12)
    return similar.cohesion(members, f, similar.idf_weights(f))


@query("greedy_clusters")
def _(get):
    """Sequential by its nature: held against a plain loop in the tests."""
    f = get("fingerprint")
    items = f.groupBy("id").agg(F.count("*").cast("int").alias("size")).select(F.lit(0).alias("part"), "id", "size", F.substring("id", 1, 2).alias("owner"))
    return similar.greedy_fingerprints(f, similar.idf_weights(f), items)


@query("package_roots", "SELECT concat('PKG_', CAST(n_regionkey AS VARCHAR)) AS root, concat('PKG_', CAST(n_regionkey AS VARCHAR), '.', n_name) AS child FROM nation UNION ALL SELECT DISTINCT 'ROOT', concat('PKG_', CAST(n_regionkey AS VARCHAR)) FROM nation")
def _(get):
    """A root for every package, with an edge to each of its procedures."""
    pkg = get("nation").select(F.concat(F.lit("PKG_"), F.col("n_regionkey").cast("string")).alias("root"), "n_name")
    return pkg.select("root", F.concat_ws(".", "root", "n_name").alias("child")).unionByName(pkg.select(F.lit("ROOT").alias("root"), F.col("root").alias("child")).distinct())
