"""Extraction from SQL text, pages and literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plsql
from ..functions import sqltext as T
from ..operators import resolve as R
from ..registry import query

N = T.NAME


def listed(words, rx=N):
    parts = ", ".join(f"regexp_extract_all(sql, '(?i){w}\\s+{rx}', 1)" for w in words)
    return f"list_transform(flatten([{parts}]), lambda x: upper(x))"


def names(words):
    return f"list_sort(list_filter(list_distinct({listed(words)}), lambda x: length(split_part(x, '.', -1)) >= 2 AND split_part(x, '.', -1) NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)})))"


TABLES = names(T.BEFORE_TABLE)


def braces(sql: str) -> str:
    return sql


@query("sql_tables", f"SELECT id, array_to_string({TABLES}, ',') AS tables FROM {{sql_text}}")
def _(get):
    return get("sql_text").select("id", F.array_join(T.tables(F.col("sql")), ",").alias("tables"))


@query("sql_procs", f"SELECT id, array_to_string({names(T.BEFORE_PROCEDURE)}, ',') AS procs FROM {{sql_text}}")
def _(get):
    return get("sql_text").select("id", F.array_join(T.procedures(F.col("sql")), ",").alias("procs"))


@query("sql_sequences", r"SELECT id, array_to_string(list_sort(list_transform(regexp_extract_all(sql, '(?i)(?:\w+\.)?\w+\.(?:NEXTVAL|CURRVAL)\b'), lambda x: upper(regexp_replace(x, '\.(\w+)$', ':\1')))), ',') AS seqs FROM {sql_text}")
def _(get):
    return get("sql_text").select("id", F.array_join(T.sequences(F.col("sql")), ",").alias("seqs"))


SIZE, TYPE, QUOTE = "CAST(p_size AS VARCHAR(9))", "lower(p_type)", "chr(39)"
DYN = f"""SELECT p_partkey AS id, replace(CASE p_partkey % 5 WHEN 0 THEN concat('~SELECT * FROM ~ || ~t', {SIZE}, '~ || ~ WHERE 1=1~') WHEN 1 THEN concat('~DELETE FROM tmp_', {TYPE}, '~')
    WHEN 2 THEN '~INSERT INTO ~ || l_tab' WHEN 3 THEN concat('~UPDATE u', {SIZE}, ' SET a = ~~x~~~ || ~ JOIN j_', {TYPE}, '~') ELSE concat('l_', {TYPE}) END, '~', {QUOTE}) AS e FROM {{part}}"""


@query("dynamic_sql_tables", f"SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat('T', {SIZE}) WHEN 1 THEN concat('TMP_', p_type) WHEN 3 THEN concat('J_', p_type, ',U', {SIZE}) ELSE '' END AS tables FROM part")
def _(get):
    """Tables of statements that are put together from literals and variables."""
    return get.sql(DYN).select("id", F.array_join(T.dynamic_tables(F.col("e")), ",").alias("tables"))


CODE = f"""SELECT p_partkey AS id, replace(CASE p_partkey % 3 WHEN 0 THEN concat('x := pkg_a.f', {SIZE}, '(1) + pkg_b.', {TYPE}, ' (2); -- pkg_c.no(1)', chr(10), 'y;') WHEN 1 THEN concat('/* a.', {TYPE}, '( */ do_it(~c.d(~);')
    ELSE concat('owner_', {TYPE}, '.run', {SIZE}, ' (p); z.q') END, '~', {QUOTE}) AS c FROM {{part}}"""


@query("embedded_calls", f"SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('PKG_A.F', {SIZE}, ',PKG_B.', p_type) WHEN 1 THEN '' ELSE concat('OWNER_', p_type, '.RUN', {SIZE}) END AS calls FROM part")
def _(get):
    """Calls in code, none from comments and literals."""
    return get.sql(CODE).select("id", F.array_join(T.embedded_calls(F.col("c")), ",").alias("calls"))


BODIES = f"""SELECT p_partkey AS id, replace(CASE p_partkey % 2 WHEN 0 THEN concat('BEGIN INSERT INTO audit_', {TYPE}, ' VALUES (~delete from q~); UPDATE emp', {SIZE}, ' SET x = 1; END;')
    ELSE concat('delete from t', {SIZE}, '; DELETE  FROM T', {SIZE}, '; -- merge into q', chr(10), 'Merge Into m_', {TYPE}, ' using x;') END, '~', {QUOTE}) AS b FROM {{part}}"""


@query("trigger_dml", f"SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN concat('INSERT:AUDIT_', p_type, ',UPDATE:EMP', {SIZE}) ELSE concat('DELETE:T', {SIZE}, ',MERGE:M_', p_type) END AS dml FROM part")
def _(get):
    """What the statements of a trigger's body change."""
    return get.sql(BODIES).select("id", F.array_join(T.trigger_dml(F.col("b")), ",").alias("dml"))


PIPES = f"""SELECT p_partkey AS id, translate(CASE p_partkey % 3 WHEN 0 THEN concat('[<$match:<a:1>>,<$lookup:<from: ~', p_type, '_O~, as:~o~>>,<~$out~: ~X', {SIZE}, '~>]')
    WHEN 1 THEN concat('<$merge: <into: ~M', {SIZE}, '~>>') ELSE concat('<$unionWith: <coll: ~U_', p_type, '~>>') END, '<>~', concat(chr(123), chr(125), {QUOTE})) AS p FROM {{part}}"""


@query("pipeline_refs", f"SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat(p_type, '_O,X', {SIZE}) WHEN 1 THEN concat('M', {SIZE}) ELSE concat('U_', p_type) END AS refs FROM part")
def _(get):
    """Collections that the stages of a pipeline name."""
    return get.sql(PIPES).select("id", F.array_join(T.pipeline_refs(F.col("p")), ",").alias("refs"))


@query("pipeline_stages", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '$match,$lookup,$out' WHEN 1 THEN '$merge' ELSE '$unionWith' END AS stages FROM part")
def _(get):
    return get.sql(PIPES).select("id", F.array_join(T.pipeline_stages(F.col("p")), ",").alias("stages"))


@query("collection_refs", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][A-Z0-9_]{{3,59}}'))), ',') AS refs FROM documents")
def _(get):
    return get("documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(T.all_matches(F.col("text"), "[A-Z][A-Z0-9_]{3,59}", 0))), ",").alias("refs"))


@query("detect_priority", """SELECT collection, source, count(*) OVER () AS n FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY CASE source WHEN 'REPOSITORY_MAPPING' THEN 1 WHEN 'STRING_LITERAL' THEN 3 ELSE 7 END, ord) AS r FROM {usage} WHERE domain <> 'ASIA') WHERE r = 1""")
def _(get):
    """The first source of a name wins."""
    rank = F.create_map(*[F.lit(x) for kv in {"REPOSITORY_MAPPING": 1, "STRING_LITERAL": 3, "PIPELINE_RUNTIME": 7}.items() for x in kv])[F.col("source")]
    best = R.pick_first(get("usage").filter("domain <> 'ASIA'"), ["collection"], rank, "ord").select("collection", "source")
    return best.join(best.agg(F.count("*").alias("n")))


@query("first_url", """SELECT page_id, list_filter(regexp_extract_all(html, '"([^"]*)"', 1), lambda x: regexp_matches(x, '^https?://'))[1] AS url FROM pages""")
def _(get):
    return get("pages").select("page_id", T.first_url(T.all_matches(F.col("html"), '"([^"]*)"')).alias("url"))


@query("dynamic_flows", "SELECT endpoint, bool_or(source = 'PIPELINE_RUNTIME') AS dynamic, bool_or(collection = 'COLL_7' AND op = 'READ') AS reads_7 FROM {usage} GROUP BY endpoint")
def _(get):
    u = get("usage").groupBy("endpoint").agg(F.collect_set(F.struct("source", "collection", "op")).alias("s"))
    return u.select("endpoint", F.exists("s", lambda x: x["source"] == "PIPELINE_RUNTIME").alias("dynamic"), F.exists("s", lambda x: (x["collection"] == "COLL_7") & (x["op"] == "READ")).alias("reads_7"))


@query("placeholder_keys", "SELECT p_partkey, concat('jdbc:', p_brand, '/', coalesce(CASE p_type WHEN 'ECONOMY' THEN 'eco' WHEN 'PROMO' THEN 'pro' END, 'none')) AS value FROM part")
def _(get):
    """Placeholders with defaults, looked up in a table of properties."""
    props = get.spark.createDataFrame([("ECONOMY", "eco"), ("PROMO", "pro")], "p_type string, v string")
    return get("part").join(F.broadcast(props), "p_type", "left").select("p_partkey", T.filled(F.lit("jdbc:{{brand}}/{{type}}"), {"brand": F.col("p_brand"), "type": F.coalesce("v", F.lit("none"))}).alias("value"))


@query("signature", "SELECT DISTINCT concat(p_type, '(', p_brand, ', ', split_part(p_name, ' ', -1), ')') AS sig FROM part")
def _(get):
    types = F.array(F.concat(F.lit("a.b."), "p_brand"), F.regexp_replace("p_name", " ", "."))
    return get("part").select(T.signature(F.col("p_type"), types).alias("sig")).distinct()


@query("path_normalize", "SELECT page_id, regexp_replace(regexp_replace(concat('/', regexp_extract(url, '^https?://([^?#]*)', 1), '/', lower('//V1/')), '/+', '/', 'g'), '(.)/$', '\\1') AS path FROM pages")
def _(get):
    return get("pages").select("page_id", T.joined_path(F.regexp_extract("url", "^https?://([^?#]*)", 1), F.lit("//v1/")).alias("path"))


@query("subprogram_body", "SELECT id, body_named AS by_name, body_plain AS by_block, CAST(NULL AS VARCHAR) AS none FROM {unit_source}")
def _(get):
    """A procedure that ends by its name, one that ends with its block, and one that is not there."""
    u = get("unit_source").withColumn("text", F.concat("head", "body_named", F.lit("\n"), "body_plain", F.lit("\nEND;")))
    return u.select("id", T.subprogram_source("text", "named").alias("by_name"), T.subprogram_source("text", "plain").alias("by_block"), T.subprogram_source("text", F.lit("absent")).alias("none"))


NESTED = "concat('{{\"a\":', props, ',\"k\":', CAST(event_id AS VARCHAR(20)), '}}')"


@query("json_balanced", f"SELECT event_id, {NESTED} AS body FROM events")
def _(get):
    """The first balanced object: of a text that is one, of a fenced block, and of prose around it."""
    body = F.concat(F.lit('{"a":'), "props", F.lit(',"k":'), F.col("event_id").cast("string"), F.lit("}"))
    prose = F.concat(F.lit("Result } is "), body, F.lit(" and {no} more."))
    fenced = F.concat(F.lit("See {x}:\n```json\n"), body, F.lit("\n```\nend"))
    text = F.when(F.col("event_id") % 3 == 0, prose).when(F.col("event_id") % 3 == 1, fenced).otherwise(F.concat(F.lit(" "), body))
    return get("events").select("event_id", T.json_object(text).alias("body"))


@query("safe_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS file FROM pages")
def _(get):
    return get("pages").select("page_id", T.safe_name(F.col("url")).alias("file"))


@query("template_fill", "SELECT n_nationkey, concat('Nation ', n_name, ' in ', CAST(n_regionkey AS VARCHAR)) AS text FROM nation")
def _(get):
    return get("nation").select("n_nationkey", T.filled(F.lit("Nation {{name}} in {{region}}"), {"name": F.col("n_name"), "region": F.col("n_regionkey").cast("string")}).alias("text"))


@query("mask_uri", "SELECT page_id, regexp_replace(concat('db://usr:pw', CAST(page_id AS VARCHAR), '@', regexp_extract(url, '^https?://([^/]*)', 1)), '://([^:/@]+):([^@]+)@', '://\\1:***@') AS uri FROM pages")
def _(get):
    uri = F.concat(F.lit("db://usr:pw"), F.col("page_id").cast("string"), F.lit("@"), F.regexp_extract("url", "^https?://([^/]*)", 1))
    return get("pages").select("page_id", T.masked_uri(uri).alias("uri"))


def unit_facts(get):
    """Facts of all units, by the parser of source text."""
    text = F.concat("head", "body_named", F.lit("\n"), "body_plain", F.lit("\nEND;"))
    return plsql.facts(get("unit_source").select(F.col("id").cast("string").alias("path"), text.alias("text")))


KEY, NAT = "CAST(s_suppkey % {0} AS VARCHAR(9))", "CAST(s_nationkey{0} AS VARCHAR(9))"
USES = " UNION ALL ".join(
    f"SELECT concat('{proc}_', CAST(s_suppkey AS VARCHAR(20))) AS proc, concat('{prefix}', {n}) AS name, '{op}' AS op, '{where}' AS context FROM supplier"
    for proc, prefix, n, op, where in (
        ("RUN", "HR.EMP_", NAT.format(""), "SELECT", ""), ("RUN", "DEPT_", NAT.format(" % 5"), "SELECT", ""), ("RUN", "ITEMS_", KEY.format(7), "SELECT", "IN"),
        ("RUN", "STOCK_", KEY.format(5), "UPDATE", ""), ("RUN", "LOG_", KEY.format(3), "INSERT", ""), ("FIX", "OLD_", KEY.format(4), "DELETE", ""),
    )
)


@query("source_tables", f"SELECT name, array_to_string(list_sort(list(DISTINCT op)), ',') AS ops, count(DISTINCT proc) AS n_procs, count(*) AS n_uses FROM ({USES}) GROUP BY name")
def _(get):
    """From source text to the roll-up of its tables."""
    t = unit_facts(get).filter("kind = 'table'")
    return t.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("op")), ",").alias("ops"), F.countDistinct("proc").alias("n_procs"), F.count("*").alias("n_uses"))


@query("source_contexts", f"SELECT op, context, count(*) AS n FROM ({USES}) GROUP BY op, context")
def _(get):
    """The subquery that a table stands in."""
    return unit_facts(get).filter("kind = 'table'").groupBy("op", F.col("detail").alias("context")).agg(F.count("*").alias("n"))


@query("source_calls", f"SELECT concat('PKG_', {KEY.format(6)}, '.GO') AS name, '2' AS args, count(*) AS n FROM supplier GROUP BY 1 UNION ALL SELECT 'F', '2', count(*) FROM supplier")
def _(get):
    return unit_facts(get).filter("kind = 'call'").groupBy("name", F.col("detail").alias("args")).agg(F.count("*").alias("n"))


@query("source_sequences", f"SELECT concat('SEQ_', {KEY.format(4)}) AS name, 'NEXTVAL' AS op, count(*) AS n FROM supplier GROUP BY 1")
def _(get):
    return unit_facts(get).filter("kind = 'sequence'").groupBy("name", "op").agg(F.count("*").alias("n"))


@query("source_joins", f"SELECT concat('DEPT_', {NAT.format(' % 5')}) AS name, 'LEFT OUTER' AS type, count(*) AS n FROM supplier GROUP BY 1")
def _(get):
    return unit_facts(get).filter("kind = 'join'").groupBy("name", F.col("op").alias("type")).agg(F.count("*").alias("n"))


@query("source_statements", """SELECT proc, statements FROM (SELECT concat('RUN_', CAST(s_suppkey AS VARCHAR(20))) AS proc, 'INSERT:1,SELECT:2,UPDATE:1' AS statements FROM supplier
    UNION ALL SELECT concat('FIX_', CAST(s_suppkey AS VARCHAR(20))), 'DELETE:1' FROM supplier)""")
def _(get):
    """Histogram of statements by procedure."""
    n = unit_facts(get).filter("kind = 'statement'").groupBy("proc", "op").agg(F.count("*").alias("n"))
    return n.groupBy("proc").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "op", F.col("n").cast("string")))), ",").alias("statements"))
