"""Aggregations over facts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import rollup as R
from ..registry import query

AGG = "array_to_string(list_sort(list(DISTINCT {0})), ',')"


def sorted_set(c: str) -> str:
    return AGG.format(c)


@query("table_rollup", f"SELECT tbl, {sorted_set('op')} AS ops, count(*) AS n_details, count(DISTINCT proc) AS n_procs FROM (SELECT DISTINCT proc, upper(tbl) AS tbl, op, line FROM {{access}}) GROUP BY tbl")
def _(get):
    return R.table_rollup(get("access"))


@query("join_pair_rollup", f"""SELECT least(left_tbl, right_tbl) AS tbl_a, greatest(left_tbl, right_tbl) AS tbl_b, {sorted_set('type')} AS types, count(*) AS n_uses,
    arg_min(concat(left_tbl, '>', right_tbl), (ord, right_tbl)) AS first_orientation FROM {{join_use}} GROUP BY 1, 2""")
def _(get):
    return R.join_pair_rollup(get("join_use"))


CURSORS = "SELECT tbl AS name, CASE WHEN line % 3 = 0 THEN NULL ELSE concat('T', CAST(line % 3 AS VARCHAR(9))) END AS type, op, ord FROM {access} WHERE sch = 'S2'"


@query("cursor_rollup", f"SELECT name, coalesce(arg_min(type, ord) FILTER (type IS NOT NULL), 'EXPLICIT') AS type, {sorted_set('op')} AS ops, count(*) AS n_uses FROM ({CURSORS}) GROUP BY name")
def _(get):
    return R.cursor_rollup(get.sql(CURSORS))


@query("sequence_rollup", f"SELECT upper(name) AS name, {sorted_set('op')} AS ops, count(DISTINCT proc) AS n_procs, count(*) AS n_uses FROM (SELECT concat('seq_', callee) AS name, CASE WHEN ord % 2 = 0 THEN 'NEXTVAL' ELSE 'CURRVAL' END AS op, caller AS proc FROM {{call}}) GROUP BY 1")
def _(get):
    return R.sequence_rollup(get.sql("SELECT concat('seq_', callee) AS name, CASE WHEN ord % 2 = 0 THEN 'NEXTVAL' ELSE 'CURRVAL' END AS op, caller AS proc FROM {call}"))


LINES = "array_to_string(list_sort(list(DISTINCT line)), ',')"


@query("ops_map", f"SELECT proc, tbl, op, {LINES} AS lines, count(DISTINCT line) AS n_lines FROM {{access}} GROUP BY proc, tbl, op")
def _(get):
    return R.ops_lines(get("access"), "proc")


@query("call_group", f"SELECT caller, callee, arg_min(type, ord) AS type, count(*) AS n_calls, {LINES} AS lines FROM {{call}} WHERE type <> 'BUILTIN' GROUP BY caller, callee")
def _(get):
    return R.call_group(get("call"))


@query("flow_totals", """SELECT count(DISTINCT caller) AS nodes, count(*) FILTER (type = 'INTERNAL') AS internal_calls, count(*) FILTER (type = 'EXTERNAL') AS external_calls,
    CAST(sum(line) AS BIGINT) AS total_lines, max(line) AS max_line FROM {call}""")
def _(get):
    return get("call").agg(F.countDistinct("caller").alias("nodes"), F.count_if(F.col("type") == "INTERNAL").alias("internal_calls"), F.count_if(F.col("type") == "EXTERNAL").alias("external_calls"), F.sum("line").alias("total_lines"), F.max("line").alias("max_line"))


@query("node_metrics", "SELECT callee, max(line) - min(line) + 1 AS loc, count(*) AS n_calls, count(DISTINCT caller) AS n_callers FROM {call} GROUP BY callee")
def _(get):
    return get("call").groupBy("callee").agg((F.max("line") - F.min("line") + 1).alias("loc"), F.count("*").alias("n_calls"), F.countDistinct("caller").alias("n_callers"))


@query("calls_out_split", "SELECT caller, count(DISTINCT CASE WHEN type = 'INTERNAL' THEN callee END) AS n_internal, count(DISTINCT CASE WHEN type <> 'INTERNAL' THEN callee END) AS n_external FROM {call} GROUP BY caller")
def _(get):
    return R.calls_out_split(get("call"))


@query("edge_dedup", f"SELECT caller AS src, callee AS dst, count(*) AS n, min(CAST(ord % 13 AS INT)) AS depth, {LINES} AS lines FROM {{call}} GROUP BY 1, 2")
def _(get):
    return R.edge_dedup(get("call").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), (F.col("ord") % 13).cast("int").alias("depth"), "line"))


@query("table_index", f"SELECT tbl, {sorted_set('proc')} AS used_by, {sorted_set('op')} AS ops, count(*) AS n FROM {{access}} GROUP BY tbl")
def _(get):
    return get("access").groupBy("tbl").agg(R.joined("proc").alias("used_by"), R.joined("op").alias("ops"), F.count("*").alias("n")).orderBy("tbl")


@query("op_histogram", "SELECT op, count(DISTINCT tbl) AS n_tables FROM {access} GROUP BY op")
def _(get):
    return R.op_histogram(get("access"))


@query("table_usage", f"SELECT tbl, op, {sorted_set('proc')} AS procs FROM {{access}} GROUP BY tbl, op")
def _(get):
    return get("access").groupBy("tbl", "op").agg(R.joined("proc").alias("procs"))


BEST = "arg_max(op, CASE op WHEN 'COUNT' THEN 1 WHEN 'AGGREGATE' THEN 2 WHEN 'READ' THEN 3 WHEN 'DELETE' THEN 4 WHEN 'UPDATE' THEN 5 WHEN 'WRITE' THEN 6 END)"


@query("endpoint_totals", f"""SELECT endpoint, count(*) AS n_uses, count(DISTINCT collection) AS n_collections, {sorted_set('op')} AS ops, count(*) FILTER (op IN ('WRITE', 'UPDATE', 'DELETE')) AS n_writes, {BEST} AS best_op
    FROM {{usage}} GROUP BY endpoint""")
def _(get):
    return R.endpoint_totals(get("usage"))


@query("coll_first_op", "SELECT endpoint, collection, arg_min(op, ord) AS op FROM {usage} GROUP BY endpoint, collection")
def _(get):
    return R.coll_first_op(get("usage"))


@query("coll_best_op", f"SELECT endpoint, collection, {BEST} AS op FROM {{usage}} GROUP BY endpoint, collection")
def _(get):
    return R.coll_best_op(get("usage"))


@query("coll_detected_op", "SELECT endpoint, collection, arg_max(op, CASE op WHEN 'READ' THEN 1 WHEN 'COUNT' THEN 2 WHEN 'WRITE' THEN 3 WHEN 'UPDATE' THEN 4 WHEN 'DELETE' THEN 5 WHEN 'AGGREGATE' THEN 6 END) AS op FROM {usage} GROUP BY endpoint, collection")
def _(get):
    return R.detected_op(get("usage"))


@query("session_stats", """SELECT session, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total_ms, CAST(sum(ms) // count(*) AS BIGINT) AS avg_ms, count(*) FILTER (NOT coalesce(success, FALSE)) AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM {call_log} GROUP BY session""")
def _(get):
    return R.session_stats(get("call_log"))


@query("summary_metrics", """SELECT label, coalesce(n, 0) AS n FROM (VALUES ('S'), ('M'), ('L'), ('XL'), ('XXL')) AS t(label) LEFT JOIN
    (SELECT CASE WHEN methods <= 5 THEN 'S' WHEN methods <= 20 THEN 'M' WHEN methods <= 50 THEN 'L' ELSE 'XL' END AS label, count(*) AS n FROM {endpoint} GROUP BY 1) USING (label)""")
def _(get):
    return R.histogram_with_zeros(get("endpoint"), C.size_class(F.col("methods")), ("S", "M", "L", "XL", "XXL"))


@query("coll_op_pivot", """SELECT collection, count(*) FILTER (op = 'AGGREGATE') AS n_aggregate, count(*) FILTER (op = 'DELETE') AS n_delete, count(*) FILTER (op IN ('READ', 'COUNT')) AS n_read,
    count(*) FILTER (op = 'UPDATE') AS n_update, count(*) FILTER (op = 'WRITE') AS n_write FROM {usage} GROUP BY collection""")
def _(get):
    return R.coll_op_pivot(get("usage"))


@query("coll_usage_detail", "SELECT endpoint, collection, op, count(*) AS n FROM {usage} GROUP BY endpoint, collection, op")
def _(get):
    """Endpoint by collection by operation, from the collections of an endpoint as an array."""
    packed = get("usage").groupBy("endpoint").agg(F.collect_list(F.struct("collection", "op")).alias("uses"))
    return packed.select("endpoint", F.inline("uses")).groupBy("endpoint", "collection", "op").agg(F.count("*").alias("n"))


@query("domain_crossing", f"SELECT collection, count(DISTINCT domain) AS n_domains, {sorted_set('domain')} AS domains FROM {{usage}} GROUP BY collection HAVING count(DISTINCT domain) > 1")
def _(get):
    return R.domain_crossing(get("usage"))


@query("type_summary", "SELECT type, count(*) AS n FROM {dict_objects} GROUP BY type")
def _(get):
    return get("dict_objects").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


@query("ambiguous_objects", "SELECT name, count(*) AS n, array_to_string(list_sort(list(concat(owner, '.', type))), ',') AS candidates FROM {dict_objects} GROUP BY name HAVING count(*) > 1")
def _(get):
    g = get("dict_objects").groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(".", "owner", "type"))), ",").alias("candidates"))
    return g.filter("n > 1")


@query("overload_detect", "SELECT p_partkey, p_name AS base_id, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN concat(p_name, '(', p_type, ',', p_brand, ')') ELSE p_name END AS id FROM part")
def _(get):
    many = F.count("*").over(W.partitionBy("p_name")) > 1
    return get("part").select("p_partkey", F.col("p_name").alias("base_id"), F.when(many, F.concat(F.col("p_name"), F.lit("("), F.concat_ws(",", "p_type", "p_brand"), F.lit(")"))).otherwise(F.col("p_name")).alias("id"))


@query("base_packages", "SELECT prefix, n FROM (SELECT regexp_extract(url, '^https?://([^/.]+[.][^/.]+)', 1) AS prefix, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, prefix LIMIT 1")
def _(get):
    """The most frequent first two parts of a name; ties by name."""
    return get("pages").groupBy(F.regexp_extract("url", r"^https?://([^/.]+[.][^/.]+)", 1).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(1)


@query("chunk_merge", "SELECT CAST(user_id AS VARCHAR) AS node, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS items, count(DISTINCT event_id % 4) AS n_chunks FROM events GROUP BY user_id")
def _(get):
    chunks = get("events").groupBy(F.col("user_id").cast("string").alias("node"), (F.col("event_id") % 4).alias("chunk")).agg(F.collect_set("event_type").alias("items"))
    return R.merge_chunks(chunks)


@query("call_sequences", f"SELECT caller, {sorted_set('name')} AS names, count(*) AS n FROM (SELECT caller, concat('seq_', callee) AS name FROM {{call}} WHERE line % 2 = 0) GROUP BY caller")
def _(get):
    """Sequences among a caller's calls: those whose name says NEXTVAL or CURRVAL."""
    calls = get("call").withColumn("name", F.concat(F.lit("seq_"), "callee", F.when(F.col("line") % 2 == 0, ".nextval").otherwise(".run")))
    used = calls.filter(F.upper("name").rlike(r"\.(NEXTVAL|CURRVAL)$"))
    return used.groupBy("caller").agg(R.joined(F.regexp_replace("name", r"\.\w+$", "")).alias("names"), F.count("*").alias("n"))


@query("distinct_tables", "SELECT count(DISTINCT tbl) AS n FROM {access}")
def _(get):
    return get("access").agg(F.countDistinct("tbl").alias("n"))


@query("improvement_notes", "SELECT event_type AS kind, user_id % 10 AS part, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, kind, part LIMIT 10")
def _(get):
    return get("events").groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 10).alias("part")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "part").limit(10)
