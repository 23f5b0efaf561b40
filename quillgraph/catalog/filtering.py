"""Projections, filters and predicates over facts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..registry import query


@query("node_search", "SELECT DISTINCT p_brand AS id, p_name AS name FROM part WHERE contains(upper(p_brand), 'RAND#1') OR contains(upper(p_name), 'RED')")
def _(get):
    """Nodes whose id or name holds a string, whatever the case."""
    hit = F.upper("p_brand").contains("RAND#1") | F.upper("p_name").contains("RED")
    return get("part").filter(hit).select(F.col("p_brand").alias("id"), F.col("p_name").alias("name")).distinct()


@query("ident_normalize", """SELECT DISTINCT upper(trim(replace(concat('"', p_name, '" '), '"', ''))) AS ident FROM part""")
def _(get):
    return get("part").select(C.normalized(F.concat(F.lit('"'), "p_name", F.lit('" '))).alias("ident")).distinct()


@query("node_id", "SELECT DISTINCT regexp_replace(upper(concat_ws('$', CASE WHEN p_size % 3 > 0 THEN concat('s', CAST(p_size % 3 AS VARCHAR)) END, p_brand, p_name)), '[^A-Z0-9_$]', '_', 'g') AS id FROM part")
def _(get):
    schema = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))).otherwise("")
    return get("part").select(C.node_id(schema, F.col("p_brand"), F.col("p_name")).alias("id")).distinct()


@query("id_dedup_suffix", """SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE concat(p_name, '$', CAST(n AS VARCHAR)) END AS id
    FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def _(get):
    """Second and later uses of an id get a number."""
    n = F.row_number().over(W.partitionBy("p_name").orderBy("p_partkey"))
    return get("part").select("p_partkey", "p_name", n.alias("n")).select("p_partkey", F.when(F.col("n") == 1, F.col("p_name")).otherwise(F.concat_ws("$", "p_name", F.col("n").cast("string"))).alias("id"))


@query("alias_antijoin", """SELECT a.proc, a.tbl, count(*) AS n FROM {access} a WHERE a.sch = 'S1' OR NOT EXISTS (
    SELECT 1 FROM {access} b WHERE b.proc = a.proc AND b.tbl = a.tbl AND b.op = 'DELETE' AND b.line = 1) GROUP BY a.proc, a.tbl""")
def _(get):
    """References whose bare name is an alias of the procedure go; names with a schema stay."""
    a = get("access")
    alias = a.filter("op = 'DELETE' AND line = 1").select("proc", "tbl").distinct()
    bare = a.filter("sch <> 'S1'").join(alias, ["proc", "tbl"], "left_anti")
    return a.filter("sch = 'S1'").unionByName(bare).groupBy("proc", "tbl").agg(F.count("*").alias("n"))


CALLED = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'dbms_output' WHEN 1 THEN 'UTL_FILE' WHEN 2 THEN 'htp' WHEN 3 THEN 'sys.pk' WHEN 4 THEN concat('PKG_', event_type) WHEN 5 THEN 'MY_DBMS_X' END AS pkg,
    CASE event_id % 5 WHEN 0 THEN 'nvl' WHEN 1 THEN 'Regexp_Instr' WHEN 2 THEN concat('run_', event_type) WHEN 3 THEN 'sql%rowcount' ELSE 'nvl3' END AS name FROM {events}"""


@query("builtin_filter", f"SELECT pkg, name, count(*) AS n FROM ({CALLED}) WHERE event_id % 9 NOT IN (0, 1, 2, 3) AND (event_id % 9 IN (4, 5) OR event_id % 5 IN (2, 4)) GROUP BY pkg, name")
def _(get):
    """Calls without those of the database's own packages, and of its functions where no package is named."""
    own = C.builtin_package(F.col("pkg")) | (F.col("pkg").isNull() & C.builtin_function(F.col("name")))
    return get.sql(CALLED).filter(~own).groupBy("pkg", "name").agg(F.count("*").alias("n"))


@query("wrapped_detect", "SELECT doc_id, regexp_matches(substring(text, 1, 300), '(?i)\\bwrapped\\b|\\b[0-9a-fA-F]{{8,}}\\b') AS wrapped FROM documents")
def _(get):
    return get("documents").select("doc_id", C.wrapped(F.col("text")).alias("wrapped"))


@query("name_heuristic", "SELECT DISTINCT collection, length(collection) BETWEEN 4 AND 60 AND contains(collection, '_') AND regexp_matches(collection, '^[A-Z][A-Z0-9_]+$') AS likely FROM {usage}")
def _(get):
    return get("usage").select("collection", C.likely_collection(F.col("collection")).alias("likely")).distinct()


@query("library_filter", "SELECT p_type, count(*) AS n FROM part WHERE NOT regexp_matches(p_name, '^(red|blue)') GROUP BY p_type")
def _(get):
    return get("part").filter(~F.col("p_name").rlike("^(red|blue)")).groupBy("p_type").agg(F.count("*").alias("n"))


@query("noise_filter", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view') AND NOT regexp_matches(event_type, '^(get|set|is)')")
def _(get):
    return get("events").filter(~F.col("event_type").isin("view") & ~F.col("event_type").rlike("^(get|set|is)")).select("event_id", "event_type")


FIRED = "SELECT tbl, proc, CASE WHEN line = 7 THEN 'MERGE' ELSE op END AS op FROM {access}"
TRIGGERS = "SELECT DISTINCT concat('Brand#', CAST(s_nationkey AS VARCHAR(9))) AS t, CASE s_suppkey % 3 WHEN 0 THEN 'delete or insert' WHEN 1 THEN 'UPDATE' ELSE 'INSERT' END AS event FROM {supplier}"


@query("trigger_match", f"SELECT DISTINCT tbl, op FROM ({FIRED}) a JOIN ({TRIGGERS}) g ON g.t = a.tbl WHERE op = 'MERGE' OR (op = 'DELETE' AND event = 'delete or insert') OR (op = 'UPDATE' AND event = 'UPDATE')")
def _(get):
    """Operations on tables that fire a trigger."""
    a = get.sql(FIRED).select("tbl", "op").distinct()
    return a.join(get.sql(TRIGGERS), (F.col("t") == F.col("tbl")) & C.fires(F.col("event"), F.col("op")), "left_semi")


@query("dml_tables", "SELECT proc, tbl FROM {access} GROUP BY proc, tbl HAVING count(*) FILTER (op IN ('UPDATE', 'DELETE')) > 0")
def _(get):
    ops = get("access").groupBy("proc", "tbl").agg(F.collect_set("op").alias("ops"))
    return ops.filter(F.arrays_overlap("ops", F.array(F.lit("INSERT"), F.lit("UPDATE"), F.lit("DELETE"), F.lit("MERGE")))).select("proc", "tbl")


@query("evidence_filter", """SELECT count(*) AS n FROM {call} c WHERE NOT (
    EXISTS (SELECT 1 FROM {edge_cyc} e WHERE e.src = replace(c.caller, 'P', 'U')) AND c.callee <> 'purchase' AND c.callee NOT IN ('view', 'click'))""")
def _(get):
    """A call goes only if its caller has dependency data, and it is neither a dependency nor a known object."""
    has = get("edge_cyc").select(F.regexp_replace("src", "U", "P").alias("caller"), F.lit(True).alias("has")).distinct()
    known = F.col("callee").isin("view", "click")
    c = get("call").join(has, "caller", "left")
    return c.filter(~(F.coalesce("has", F.lit(False)) & (F.col("callee") != "purchase") & ~known)).agg(F.count("*").alias("n"))


@query("session_filter", "SELECT event_id, ms FROM {call_log} WHERE session = 's7' ORDER BY event_id LIMIT 25")
def _(get):
    return get("call_log").filter("session = 's7'").select("event_id", "ms").orderBy("event_id").limit(25)
