"""Queries over dictionary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.resolve import pick_first
from ..registry import query

ORDER = {"TABLE": 1, "VIEW": 2, "MATERIALIZED VIEW": 3}


@query("owner_priority", "SELECT name, owner FROM (SELECT name, owner, row_number() OVER (PARTITION BY name ORDER BY CASE type WHEN 'TABLE' THEN 1 WHEN 'VIEW' THEN 2 WHEN 'MATERIALIZED VIEW' THEN 3 ELSE 4 END, ord) AS r FROM {dict_objects}) WHERE r = 1")
def _(get):
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("type")], F.lit(4))
    return pick_first(get("dict_objects"), ["name"], rank, "ord").select("name", "owner")


@query("tuple_semi", "SELECT owner, name, type FROM {dict_objects} WHERE (owner, name) IN (SELECT owner, name FROM {dict_objects} WHERE type = 'VIEW')")
def _(get):
    d = get("dict_objects")
    return d.join(d.filter("type = 'VIEW'").select("owner", "name"), ["owner", "name"], "left_semi").select("owner", "name", "type")


@query("owner_union", "SELECT owner FROM {dict_objects} WHERE type = 'TABLE' UNION SELECT owner FROM {dict_objects} WHERE type = 'VIEW'")
def _(get):
    d = get("dict_objects")
    return d.filter("type = 'TABLE'").select("owner").union(d.filter("type = 'VIEW'").select("owner")).distinct()


@query("table_type_probe", "SELECT name, CASE WHEN bool_or(type = 'MATERIALIZED VIEW') THEN 'MVIEW' WHEN bool_or(type = 'VIEW') THEN 'VIEW' WHEN bool_or(type = 'TABLE') THEN 'TABLE' ELSE 'UNKNOWN' END AS kind FROM {dict_objects} GROUP BY name")
def _(get):
    has = lambda t: F.bool_or(F.col("type") == t)
    return get("dict_objects").groupBy("name").agg(F.when(has("MATERIALIZED VIEW"), "MVIEW").when(has("VIEW"), "VIEW").when(has("TABLE"), "TABLE").otherwise("UNKNOWN").alias("kind"))


@query("constraint_join", "SELECT o_orderpriority AS name, count(*) AS n_cols, CAST(sum(l_linenumber) AS BIGINT) AS positions FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(get):
    both = get("orders").join(get("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n_cols"), F.sum("l_linenumber").alias("positions"))


@query("index_join", "SELECT s.s_name AS idx, n.n_name AS col FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey")
def _(get):
    return get("supplier").join(get("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_name").alias("idx"), F.col("n_name").alias("col"))


@query("reverse_deps", "SELECT DISTINCT src AS name FROM {edge_dag} WHERE dst IN ('C10', 'C20', 'C30')")
def _(get):
    return get("edge_dag").filter(F.col("dst").isin("C10", "C20", "C30")).select(F.col("src").alias("name")).distinct()


@query("seed_lookup", "SELECT owner, name, type FROM {dict_objects} WHERE name IN (SELECT concat(p_type, '_', p_brand) FROM part WHERE p_size = 7)")
def _(get):
    seeds = get("part").filter("p_size = 7").select(F.concat_ws("_", "p_type", "p_brand").alias("name"))
    return get("dict_objects").join(seeds, "name", "left_semi").select("owner", "name", "type")


@query("triggers_by_table", "SELECT c_mktsegment AS tbl, array_to_string(list_sort(list(n_name)), ',') AS trigs FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000) GROUP BY 1")
def _(get):
    c = get("customer").filter("c_acctbal > 9000").join(get("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_mktsegment", "n_name").distinct()
    return c.groupBy(F.col("c_mktsegment").alias("tbl")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("trigs"))


@query("source_lines", "SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS src FROM conversations GROUP BY conv_id")
def _(get):
    """Source lines as one text, in order of line."""
    g = get("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return g.select("conv_id", F.array_join(F.transform("l", lambda x: x["role"]), "|").alias("src"))


@query("trigger_ddl", "SELECT d.doc_id, coalesce(b.item_id, l.quality, -1) AS v FROM documents d LEFT JOIN (SELECT item_id, item_id AS doc_id FROM benchmark) b ON b.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(get):
    """One lookup, and another where the first has nothing."""
    d = get("documents").select("doc_id")
    b = get("benchmark").select(F.col("item_id").alias("doc_id"), "item_id")
    return d.join(b, "doc_id", "left").join(get("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("item_id", F.col("quality").cast("long"), F.lit(-1).cast("long")).alias("v"))


@query("direct_deps", "SELECT DISTINCT src, dst FROM {edge_dag} WHERE src IN (SELECT concat('N', CAST(n_nationkey AS VARCHAR(20))) FROM {nation} WHERE n_regionkey = 2) AND dst NOT LIKE 'C1%'")
def _(get):
    """What objects of a seed list depend on directly, some kinds left out."""
    seeds = get("nation").filter("n_regionkey = 2").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("src"))
    return get("edge_dag").join(seeds, "src", "left_semi").filter("dst NOT LIKE 'C1%'").select("src", "dst").distinct()


@query("object_deps", "SELECT src, dst, CAST(NULL AS VARCHAR) AS link, 'OUT' AS way FROM {edge_dag} WHERE src = 'N7' UNION ALL SELECT src, dst, NULL, 'IN' FROM {edge_dag} WHERE dst = 'N7'")
def _(get):
    """Dependencies and references of one object; a link is not known."""
    e = get("edge_dag").filter("src = 'N7' OR dst = 'N7'")
    return e.select("src", "dst", F.lit(None).cast("string").alias("link"), F.when(F.col("src") == "N7", "OUT").otherwise("IN").alias("way"))


@query("object_listing", "SELECT name, type, ord FROM {dict_objects} WHERE owner = 'OWN3' AND type IN ('TABLE', 'VIEW') ORDER BY type, name, ord")
def _(get):
    return get("dict_objects").filter("owner = 'OWN3' AND type IN ('TABLE', 'VIEW')").select("name", "type", "ord").orderBy("type", "name", "ord")


COLUMNS = "SELECT owner, name, n_name AS col, n_nationkey + 1 AS place FROM {dict_objects} JOIN {nation} ON n_nationkey < ord % 5"


@query("object_columns", f"SELECT owner, name, count(*) AS n, array_to_string(list(col ORDER BY place, col), ',') AS cols FROM ({COLUMNS}) GROUP BY owner, name")
def _(get):
    """Columns of each object in their order, for all objects at once."""
    g = get.sql(COLUMNS).groupBy("owner", "name").agg(F.array_sort(F.collect_list(F.struct("place", "col"))).alias("l"))
    return g.select("owner", "name", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x["col"]), ",").alias("cols"))


@query("view_texts", "SELECT owner, name, concat('SELECT * FROM ', lower(name)) AS text FROM {dict_objects} WHERE type = 'VIEW' AND (owner, name) IN (SELECT owner, name FROM {dict_objects} WHERE type = 'TABLE')")
def _(get):
    """Definitions of the views that a list of pairs asks for."""
    d = get("dict_objects")
    texts = d.filter("type = 'VIEW'").select("owner", "name", F.concat(F.lit("SELECT * FROM "), F.lower("name")).alias("text"))
    return texts.join(d.filter("type = 'TABLE'").select("owner", "name"), ["owner", "name"], "left_semi")
