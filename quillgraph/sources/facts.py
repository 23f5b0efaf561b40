"""Fact tables: schemas of code facts, and views that give the provided star schema the roles of such facts.

Each view is one SQL text that Spark and an ANSI engine read alike; ``{name}`` stands for a base table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # procedure, table, schema, operation, line, order of first sight
    "access": """SELECT s_name AS proc, p_brand AS tbl, concat('S', CAST(p_size % 3 AS VARCHAR(9))) AS sch,
        CASE l_returnflag WHEN 'A' THEN 'SELECT' WHEN 'N' THEN 'UPDATE' ELSE 'DELETE' END AS op, l_linenumber AS line,
        ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS ord
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey""",
    "join_use": """SELECT a.ord AS ord, a.proc AS proc, a.tbl AS left_tbl, b.tbl AS right_tbl, a.line AS line,
        CASE WHEN a.op = 'SELECT' THEN 'INNER' WHEN a.op = 'UPDATE' THEN 'LEFT OUTER' ELSE 'IMPLICIT' END AS type
        FROM {access} a JOIN (SELECT DISTINCT proc, tbl, line FROM {access}) b
        ON a.proc = b.proc AND a.line < b.line""",
    "edge_dag": """SELECT concat('R', CAST(n_regionkey AS VARCHAR(20))) AS src, concat('N', CAST(n_nationkey AS VARCHAR(20))) AS dst, CAST(n_nationkey AS BIGINT) AS ord FROM {nation}
        UNION ALL SELECT concat('N', CAST(c_nationkey AS VARCHAR(20))), concat('C', CAST(c_custkey AS VARCHAR(20))), 1000 + c_custkey FROM {customer}
        UNION ALL SELECT concat('C', CAST(o_custkey AS VARCHAR(20))), concat('O', CAST(o_orderkey AS VARCHAR(20))), 100000000 + o_orderkey FROM {orders}""",
    "edge_cyc": """SELECT DISTINCT concat('U', CAST(user_id % 15 AS VARCHAR(20))) AS src, concat('U', CAST((user_id * 7 + 3) % 15 AS VARCHAR(20))) AS dst FROM {events} WHERE user_id % 15 < 11""",
    "call": """SELECT concat('P', CAST(user_id AS VARCHAR(20))) AS caller, event_type AS callee, event_id AS ord, CAST(event_id % 97 AS INT) AS line,
        CASE WHEN event_type IN ('view', 'click') THEN 'INTERNAL' WHEN event_type = 'error' THEN 'BUILTIN' ELSE 'EXTERNAL' END AS type FROM {events}""",
    "endpoint": """SELECT o_orderkey AS id, concat(n_name, 'Controller') AS controller, r_name AS domain, o_orderpriority AS archive, o_orderstatus AS status,
        CAST(count(*) * 5 AS INT) AS methods, CAST(sum(CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END) AS INT) AS db_ops, CAST(sum(l_quantity) AS BIGINT) AS loc
        FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey
        GROUP BY o_orderkey, n_name, r_name, o_orderpriority, o_orderstatus""",
    "usage": """SELECT o_orderkey AS endpoint, r_name AS domain, concat('COLL_', replace(p_brand, 'Brand#', '')) AS collection,
        CASE l_linenumber % 6 WHEN 0 THEN 'READ' WHEN 1 THEN 'WRITE' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'DELETE' WHEN 4 THEN 'AGGREGATE' ELSE 'COUNT' END AS op,
        CASE l_returnflag WHEN 'A' THEN 'STRING_LITERAL' WHEN 'N' THEN 'REPOSITORY_MAPPING' ELSE 'PIPELINE_RUNTIME' END AS source,
        ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS ord
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey JOIN {customer} ON c_custkey = o_custkey
        JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey""",
    "call_log": """SELECT event_id, ts, concat('s', CAST(user_id % 40 AS VARCHAR(9))) AS session, CAST(floor(value * 10) AS BIGINT) AS ms,
        CASE WHEN event_type = 'error' THEN FALSE WHEN event_id % 50 = 0 THEN NULL ELSE TRUE END AS success FROM {events}""",
    "fingerprint": """SELECT DISTINCT concat('E', CAST(user_id AS VARCHAR(9))) AS id, concat(CASE event_type WHEN 'view' THEN 'coll:' WHEN 'click' THEN 'domain:' ELSE 'method:' END,
        event_type, CAST(event_id % 10 AS VARCHAR(9))) AS dep FROM {events}""",
    "size_seq": "SELECT doc_id AS ord, source AS label, n_chars AS size FROM {documents}",
    "dict_objects": """SELECT concat('OWN', CAST(p_size % 5 AS VARCHAR(9))) AS owner, concat(p_type, '_', p_brand) AS name,
        CASE p_partkey % 4 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'SYNONYM' ELSE 'MATERIALIZED VIEW' END AS type, p_partkey AS ord FROM {part}""",
    "sql_text": """SELECT * FROM (VALUES
        (1, 'SELECT e.id, d.name FROM hr.employees e JOIN departments d ON e.dept_id = d.id WHERE e.salary > 100'),
        (2, 'insert into audit_log (id, act) values (audit_seq.NEXTVAL, ''x'')'),
        (3, 'UPDATE orders SET status = 1 WHERE id IN (SELECT order_id FROM staging.order_items)'),
        (4, 'DELETE FROM error_log WHERE logged_at < SYSDATE - 30'),
        (5, 'MERGE INTO inventory t USING deliveries s ON (t.id = s.id) WHEN MATCHED THEN UPDATE SET t.qty = s.qty'),
        (6, 'TRUNCATE TABLE tmp_load'), (7, '{{call pkg_billing.close_period(?, ?)}}'), (8, 'BEGIN pkg_admin.refresh_all(1); END;'),
        (9, 'EXEC sync_accounts'), (10, 'SELECT finance.invoice_seq.CURRVAL, seq_two.nextval FROM DUAL'),
        (11, 'SELECT a.x FROM t1 a, t2 b WHERE a.k = b.k(+)'), (12, '  with q as (select 1 from base_tbl) select * from q left join extra_tbl x on 1 = 1'),
        (13, 'CALL proc_only()'), (14, ''), (15, 'COMMIT')) AS t(id, sql)
        UNION ALL SELECT CAST(100 + p_partkey AS INT), CASE p_partkey % 13
        WHEN 0 THEN concat('SELECT x.a FROM ', lower(p_type), '.t', CAST(p_size AS VARCHAR(9)), ' x left join u', CAST(p_partkey % 31 AS VARCHAR(9)), ' y on x.k = y.k')
        WHEN 1 THEN concat('insert into t', CAST(p_size AS VARCHAR(9)), ' select q from src_', lower(p_type), ' fetch first 1 rows only')
        WHEN 2 THEN concat('UPDATE ', p_type, '_tab SET a = seq_', CAST(p_size AS VARCHAR(9)), '.NEXTVAL')
        WHEN 3 THEN concat('DELETE FROM a.b.c', CAST(p_size AS VARCHAR(9)), ' WHERE k IN (SELECT k FROM dual)')
        WHEN 4 THEN concat('TRUNCATE tmp_', CAST(p_size AS VARCHAR(9))) WHEN 5 THEN concat('truncate table tmp_', lower(p_type))
        WHEN 6 THEN concat('{{? = call pkg_', lower(p_type), '.f', CAST(p_size AS VARCHAR(9)), '(?)}}')
        WHEN 7 THEN concat('BEGIN UPDATE t', CAST(p_size AS VARCHAR(9)), ' SET a = 1; END;') WHEN 8 THEN concat('BEGIN p', CAST(p_size AS VARCHAR(9)), '.go(1); END;')
        WHEN 9 THEN concat('MERGE INTO m', CAST(p_size AS VARCHAR(9)), ' USING n', CAST(p_size AS VARCHAR(9)), ' ON (1 = 1) WHEN MATCHED THEN UPDATE SET z = 2')
        WHEN 10 THEN concat('EXECUTE run_', lower(p_type)) WHEN 11 THEN concat('SELECT s.q', CAST(p_size AS VARCHAR(9)), '.currval FROM DUAL, x') ELSE concat('  ', p_name) END FROM {part}""",
    # a package body for each supplier, two procedures each: the first ends by its name, the second does not
    "unit_source": """SELECT s_suppkey AS id, concat('run_', CAST(s_suppkey AS VARCHAR(20))) AS named, concat('fix_', CAST(s_suppkey AS VARCHAR(20))) AS plain,
        concat('PACKAGE BODY pk', CAST(s_suppkey AS VARCHAR(20)), ' AS', chr(10)) AS head,
        concat('PROCEDURE run_', CAST(s_suppkey AS VARCHAR(20)), ' IS', chr(10), 'BEGIN', chr(10), '  -- DELETE FROM nowhere', chr(10),
            '  SELECT a.x INTO v FROM hr.emp_', CAST(s_nationkey AS VARCHAR(9)), ' a LEFT OUTER JOIN dept_', CAST(s_nationkey % 5 AS VARCHAR(9)), ' d ON a.k = d.k WHERE a.id IN (SELECT id FROM items_', CAST(s_suppkey % 7 AS VARCHAR(9)), ');', chr(10),
            '  UPDATE stock_', CAST(s_suppkey % 5 AS VARCHAR(9)), ' SET q = 1 WHERE id = 3;', chr(10),
            '  INSERT INTO log_', CAST(s_suppkey % 3 AS VARCHAR(9)), ' VALUES (seq_', CAST(s_suppkey % 4 AS VARCHAR(9)), '.NEXTVAL, ''from x'');', chr(10),
            '  pkg_', CAST(s_suppkey % 6 AS VARCHAR(9)), '.go(1, f(2, 3));', chr(10), 'END run_', CAST(s_suppkey AS VARCHAR(20)), ';') AS body_named,
        concat('PROCEDURE fix_', CAST(s_suppkey AS VARCHAR(20)), ' IS', chr(10), 'BEGIN', chr(10), '  BEGIN DELETE FROM old_', CAST(s_suppkey % 4 AS VARCHAR(9)), '; END;', chr(10), '  COMMIT;', chr(10), 'END;') AS body_plain FROM {supplier}""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a fact view."""
    if name in VIEWS:
        return spark_sql(spark, sf_dir, VIEWS[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names_in(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over views and tables named in braces."""
    named = {n: load(spark, sf_dir, n) for n in names_in(text)}
    return spark.sql(text, **named) if named else spark.sql(text.replace("{{", "{").replace("}}", "}"))


def plain_sql(text: str) -> str:
    """The same SQL for an engine that has the base tables: views become common table expressions, each after those it reads."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in names_in(sql):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(text)
    bare = lambda s: re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", s).replace("{{", "{").replace("}}", "}")
    body = bare(text).strip()
    head = ", ".join(f"{n} AS ({bare(VIEWS[n])})" for n in order)
    if not head:
        return body
    if m := re.match(r"(?is)with\s+(recursive\s+)?", body):
        return f"WITH RECURSIVE {head}, {body[m.end():]}" if m[1] else f"WITH {head}, {body[m.end():]}"
    return f"WITH {head} {body}"
