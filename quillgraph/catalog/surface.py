"""The SQL surface of the recognised dialect over the star schema.

Most constructs are one text for both engines; where Spark has no syntax, the plan builders of ``plans.dialect`` stand in.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import dialect as D
from ..registry import query, surface

# joins
surface("sql_join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > 400000")
surface("sql_join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN (SELECT * FROM {orders} WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey")
surface("sql_join_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM {orders} WHERE o_orderstatus = 'P') o RIGHT JOIN {customer} ON o_custkey = c_custkey")
surface("sql_join_full", "SELECT s.s_suppkey AS s, c.c_custkey AS c FROM {supplier} s FULL OUTER JOIN (SELECT * FROM {customer} WHERE c_acctbal > 5000) c ON s.s_suppkey = c.c_custkey")
surface("sql_join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
surface("sql_join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation}) x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM {supplier}) y")
surface("sql_join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
surface("sql_join_semi", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 450000", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000")
surface("sql_join_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
surface("sql_join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation}) x JOIN (SELECT c_nationkey AS k, c_name AS b FROM {customer}) y USING (k)")
surface("sql_join_apply", D.rewrite("SELECT n_name, x.c_custkey FROM {nation} n CROSS APPLY (SELECT c_custkey FROM {customer} c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) x"))


@query("sql_join_plus", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def _(get):
    return D.outer_plus(get("customer"), get("orders").filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("sql_join_partitioned_outer", """SELECT s.o_orderstatus AS status, p.o_orderpriority AS priority, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
    LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority GROUP BY 1, 2""")
def _(get):
    o = get("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_orderkey", "o_totalprice")
    states = o.select("status").distinct()
    big = o.filter("o_totalprice > 480000")
    grid = states.crossJoin(o.select("priority").distinct())  # a handful of codes each
    return grid.join(big, ["status", "priority"], "left").groupBy("status", "priority").agg(F.count("o_orderkey").alias("n"))


# set operations
surface("sql_set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
surface("sql_set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
surface("sql_set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")
surface("sql_set_minus", D.rewrite("SELECT c_nationkey AS k FROM {customer} MINUS SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 0"), "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")


@query("sql_multiset", """SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u, array_to_string(list_sort(list_intersect(a, b)), ',') AS i, list_contains(a, 'view') AS has FROM (SELECT user_id % 20 AS k,
    list(event_type) FILTER (event_id % 2 = 0) AS a, list(event_type) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(get):
    e = get("events").groupBy((F.col("user_id") % 20).alias("k")).agg(F.collect_list(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_list(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))
    e = e.filter("size(a) > 0 AND size(b) > 0")
    return e.select("k", F.array_join(F.sort_array(F.array_union("a", "b")), ",").alias("u"), F.array_join(F.sort_array(F.array_intersect("a", "b")), ",").alias("i"), F.array_contains("a", "view").alias("has"))


# subqueries and common table expressions
surface("sql_subq_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM {orders})")
surface("sql_subq_correlated", "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer}")
surface("sql_subq_exists", "SELECT n_name FROM {nation} WHERE EXISTS (SELECT 1 FROM {supplier} WHERE s_nationkey = n_nationkey AND s_acctbal > 8000)")
surface("sql_subq_not_in", "SELECT n_name FROM {nation} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000)")
surface("sql_subq_all_any", "SELECT c_custkey FROM {customer} WHERE c_acctbal > (SELECT max(s_acctbal) FROM {supplier} WHERE s_nationkey < 5)", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5)")
surface("sql_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 3000000) SELECT c_name, round(t, 2) AS t FROM top JOIN {customer} ON c_custkey = o_custkey")
surface("sql_cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@query("sql_hier", "WITH RECURSIVE h(node, lvl, path) AS (SELECT DISTINCT src, 1, src FROM {edge_dag} WHERE src = 'R1' UNION ALL SELECT e.dst, h.lvl + 1, concat(h.path, '/', e.dst) FROM h JOIN (SELECT DISTINCT src, dst FROM {edge_dag}) e ON e.src = h.node) SELECT node, lvl AS level, path FROM h")
def _(get):
    start = get.spark.createDataFrame([("R1",)], "root string")
    return D.connect_by(get("edge_dag"), start).select("node", "level", "path")


# pivot and groups
surface("sql_pivot", "SELECT * FROM (SELECT o_orderpriority AS p, o_orderstatus AS s, o_orderkey AS k FROM {orders}) PIVOT (count(k) FOR s IN ('F' AS n_f, 'O' AS n_o, 'P' AS n_p))",
        "SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
surface("sql_unpivot", "SELECT l_orderkey, kind, v FROM (SELECT l_orderkey, l_partkey, l_suppkey FROM {lineitem}) UNPIVOT (v FOR kind IN (l_partkey, l_suppkey))",
        "SELECT l_orderkey, 'l_partkey' AS kind, l_partkey AS v FROM lineitem UNION ALL SELECT l_orderkey, 'l_suppkey', l_suppkey FROM lineitem")
surface("sql_group_having", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS t FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 590")
surface("sql_group_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS g FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
surface("sql_group_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
surface("sql_group_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")

# aggregates
surface("sql_agg_basic", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_tax), 6) AS avg_tax, min(l_shipdate) AS first_ship, max(l_quantity) AS max_qty, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
surface("sql_agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM {lineitem} GROUP BY l_returnflag")
surface("sql_agg_stats", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(variance(l_tax), 8) AS vt, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 8) AS cp, median(l_quantity) AS med FROM {lineitem} GROUP BY l_returnflag")
surface("sql_agg_regr", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM {lineitem}")
surface("sql_agg_percentile", "SELECT o_orderstatus, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS p50 FROM {orders} GROUP BY o_orderstatus")
surface("sql_agg_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
surface("sql_agg_json", "SELECT n_regionkey, to_json(array_sort(collect_list(n_name))) AS j FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list_sort(list(n_name))) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
surface("sql_agg_hypothetical", "SELECT o_orderstatus, count_if(o_totalprice < 100000) + 1 AS rank_of, round(count_if(o_totalprice <= 100000) / count(*), 6) AS share FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) FILTER (o_totalprice < 100000) + 1 AS rank_of, round(count(*) FILTER (o_totalprice <= 100000) / count(*), 6) AS share FROM orders GROUP BY o_orderstatus")


@query("sql_agg_keep", "SELECT o_orderstatus, count(*) AS n_first, round(max(o_totalprice), 2) AS best FROM (SELECT *, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1 GROUP BY o_orderstatus")
def _(get):
    return D.keep_dense(get("orders"), ["o_orderstatus"], [F.desc("o_orderdate")], F.count("*").alias("n_first"), F.round(F.max("o_totalprice"), 2).alias("best"))


# windows
surface("sql_win_rank", "SELECT c_custkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, round(percent_rank() OVER w, 6) AS p, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INT) AS n FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)")
surface("sql_win_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS INT) AS q FROM {customer}")
surface("sql_win_lead_lag", "SELECT event_id, lead(event_type) OVER w AS nxt, lag(event_type, 2, 'none') OVER w AS prv FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
surface("sql_win_first_last", "SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
surface("sql_win_ignore_nulls", "SELECT event_id, last_value(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM {events})",
        "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)")
surface("sql_win_nth", "SELECT event_id, nth_value(event_type, 3) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM {events}")
surface("sql_win_cume", "SELECT c_custkey, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 6) AS c FROM {customer}")
surface("sql_win_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM {events}")
surface("sql_win_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 50000 PRECEDING AND CURRENT ROW) AS near FROM {orders}")


@query("sql_win_ratio", "SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 8) AS share FROM customer")
def _(get):
    return get("customer").select("c_custkey", F.round(D.ratio_to_report(F.col("c_acctbal"), "c_nationkey"), 8).alias("share"))


# order and limits
surface("sql_topn", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
surface("sql_page", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 100")


@query("sql_ties", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def _(get):
    return D.fetch_first(get("part"), [F.desc("p_size")], n=10, ties=True).select("p_partkey", "p_size")


@query("sql_percent", "SELECT p_partkey FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n, count(*) OVER () AS c FROM part) WHERE n <= ceil(c * 5 / 100)")
def _(get):
    return D.fetch_first(get("part"), [F.desc("p_retailprice"), F.col("p_partkey")], percent=5).select("p_partkey")


# scalars
surface("sql_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS a, CASE WHEN o_totalprice > 300000 THEN 'hi' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'lo' END AS b FROM {orders}")
surface("sql_str", "SELECT n_nationkey, substr(n_name, 2, 3) AS s, instr(n_name, 'ION') AS i, length(n_name) AS l, upper(n_name) AS u, lower(n_name) AS lo, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '*') AS rp, replace(n_name, 'N', 'x') AS r, translate(n_name, 'AT', 'at') AS t, chr(65 + n_nationkey) AS c, ascii(n_name) AS a, ltrim(rtrim(concat('  ', n_name, ' '))) AS tr, n_name || '!' AS cc FROM {nation}",
        "SELECT n_nationkey, substr(n_name, 2, 3) AS s, CAST(instr(n_name, 'ION') AS INT) AS i, CAST(length(n_name) AS INT) AS l, upper(n_name) AS u, lower(n_name) AS lo, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '*') AS rp, replace(n_name, 'N', 'x') AS r, translate(n_name, 'AT', 'at') AS t, chr(65 + n_nationkey) AS c, CAST(ascii(n_name) AS INT) AS a, trim(concat('  ', n_name, ' ')) AS tr, n_name || '!' AS cc FROM nation")
surface("sql_initcap", "SELECT p_partkey, initcap(p_name) AS n FROM {part}", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS n FROM part")
surface("sql_regex", r"SELECT page_id, regexp_replace(url, '[0-9]+', '#') AS r, regexp_extract(url, '^(https?)://([^/]+)', 2) AS h, url RLIKE 'ref=' AS m, regexp_count(url, '/') AS n, regexp_substr(url, '[a-z]+[.]example') AS s FROM {pages}",
        r"SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS r, regexp_extract(url, '^(https?)://([^/]+)', 2) AS h, regexp_matches(url, 'ref=') AS m, CAST(len(regexp_extract_all(url, '/')) AS INT) AS n, nullif(regexp_extract(url, '[a-z]+[.]example'), '') AS s FROM pages")
surface("sql_num", "SELECT l_orderkey, round(l_extendedprice, 1) AS r, floor(l_tax * 100) AS f, ceil(l_quantity / 3) AS c, l_orderkey % 7 AS m, abs(l_quantity - 25) AS a, sign(l_quantity - 25) AS s, round(sqrt(l_quantity), 6) AS q, power(l_linenumber, 2) AS p FROM {lineitem} WHERE l_orderkey < 200",
        "SELECT l_orderkey, round(l_extendedprice, 1) AS r, CAST(floor(l_tax * 100) AS BIGINT) AS f, CAST(ceil(l_quantity / 3) AS BIGINT) AS c, l_orderkey % 7 AS m, abs(l_quantity - 25) AS a, CAST(sign(l_quantity - 25) AS DOUBLE) AS s, round(sqrt(l_quantity), 6) AS q, power(l_linenumber, 2) AS p FROM lineitem WHERE l_orderkey < 200")
surface("sql_null", "SELECT o_orderkey, nvl(nullif(o_orderstatus, 'F'), 'was F') AS a, nvl2(nullif(o_orderstatus, 'O'), 'x', 'y') AS b, decode(o_orderstatus, 'F', 1, 'O', 2, 0) AS c, coalesce(nullif(o_orderpriority, '1-URGENT'), '-') AS d FROM {orders}",
        "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'was F') AS a, CASE WHEN nullif(o_orderstatus, 'O') IS NOT NULL THEN 'x' ELSE 'y' END AS b, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS c, coalesce(nullif(o_orderpriority, '1-URGENT'), '-') AS d FROM orders")
surface("sql_date", "SELECT o_orderkey, add_months(o_orderdate, 3) AS a, last_day(o_orderdate) AS l, extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS t, datediff(DATE'2002-01-01', o_orderdate) AS d FROM {orders}",
        "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS a, last_day(o_orderdate) AS l, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(MONTH FROM o_orderdate) AS INT) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS d FROM orders")
surface("sql_conv", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS d, try_cast(o_orderpriority AS INT) AS bad, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p, CAST(o_totalprice AS DECIMAL(15, 1)) AS dec, to_date('2020-02-03', 'yyyy-MM-dd') AS dt FROM {orders}",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, TRY_CAST(o_orderpriority AS INT) AS bad, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p, CAST(o_totalprice AS DECIMAL(15, 1)) AS dec, DATE '2020-02-03' AS dt FROM orders")
surface("sql_interval", "SELECT event_id, ts + INTERVAL '1' DAY AS a, ts - INTERVAL '90' MINUTE AS b FROM {events}", "SELECT event_id, ts + INTERVAL 1 DAY AS a, ts - INTERVAL 90 MINUTE AS b FROM events")
surface("sql_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k + 1 AS k1, try_parse_json(props) IS NOT NULL AS ok FROM {events}", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k, CAST(props->>'$.k' AS INT) + 1 AS k1, json_valid(props) AS ok FROM events")
surface("sql_xml", "SELECT n_nationkey, xpath_string(concat('<n><k>', n_nationkey, '</k><v>', n_name, '</v></n>'), 'n/v') AS v FROM {nation}", "SELECT n_nationkey, n_name AS v FROM nation")
surface("sql_coll", "SELECT id, element_at(a, 1) AS first, size(a) AS n, array_contains(a, 'x') AS has, size(array_distinct(a)) = size(a) AS is_set FROM (SELECT n_nationkey AS id, split(n_name, '_') AS a FROM {nation})",
        "SELECT id, a[1] AS first, CAST(len(a) AS INT) AS n, list_contains(a, 'x') AS has, len(list_distinct(a)) = len(a) AS is_set FROM (SELECT n_nationkey AS id, string_split(n_name, '_') AS a FROM nation)")
surface("sql_unnest", "SELECT n_nationkey, w FROM {nation} LATERAL VIEW explode(split(n_name, '_')) t AS w", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS w FROM nation")
surface("sql_predicates", r"SELECT p_partkey FROM {part} WHERE (p_size BETWEEN 5 AND 20 OR p_name LIKE 'r%t') AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#23') AND NOT (p_type = 'PROMO') AND p_name IS NOT NULL AND p_retailprice <> 0")
surface("sql_like_escape", r"SELECT n_name FROM {nation} WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'")
surface("sql_dual", D.rewrite("SELECT 1 + 1 AS two FROM DUAL"), "SELECT 1 + 1 AS two")
surface("sql_fetch", D.rewrite("SELECT o_orderkey FROM {orders} ORDER BY o_orderkey OFFSET 5 ROWS FETCH FIRST 7 ROWS ONLY"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5")


@query("sql_strict_least", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE least(c_acctbal, 5000) END AS low FROM customer")
def _(get):
    return get("customer").select("c_custkey", D.strict_least(F.col("c_acctbal"), F.when(F.col("c_custkey") % 3 != 0, F.lit(5000.0))).alias("low"))


# changes, as new versions of a table
NEW = "SELECT p_partkey, concat(p_name, ' new') AS p_name, p_size FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey + 1000000, p_name, p_size FROM part WHERE p_partkey % 50 = 0"


@query("sql_merge", f"SELECT coalesce(t.p_partkey, s.p_partkey) AS p_partkey, CASE WHEN s.p_partkey IS NOT NULL THEN s.p_name ELSE t.p_name END AS p_name, coalesce(t.p_size, s.p_size) AS p_size FROM part t FULL JOIN ({NEW}) s ON s.p_partkey = t.p_partkey WHERE NOT (t.p_partkey IS NOT NULL AND s.p_partkey IS NOT NULL AND t.p_size > 45)")
def _(get):
    p = get("part").select("p_partkey", "p_name", "p_size")
    s = p.filter("p_partkey % 10 = 0").withColumn("p_name", F.concat("p_name", F.lit(" new"))).unionByName(p.filter("p_partkey % 50 = 0").withColumn("p_partkey", F.col("p_partkey") + 1000000))
    return D.merge(p, s, "p_partkey", {"p_name": F.col("s.p_name")}, delete=F.col("t.p_size") > 45)


surface("sql_multi_insert", "SELECT 'big' AS target, o_orderkey FROM {orders} WHERE o_totalprice > 400000 UNION ALL SELECT 'urgent', o_orderkey FROM {orders} WHERE o_orderpriority = '1-URGENT'")
surface("sql_update", "SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN round(c_acctbal * 1.1, 4) ELSE c_acctbal END AS c_acctbal FROM {customer}")
surface("sql_delete", "SELECT c_custkey FROM {customer} WHERE NOT coalesce(c_acctbal < 0, FALSE)")


@query("merge_upsert", f"SELECT coalesce(s.p_partkey, t.p_partkey) AS p_partkey, coalesce(s.p_name, t.p_name) AS p_name, coalesce(s.p_size, t.p_size) AS p_size FROM part t FULL JOIN ({NEW}) s ON s.p_partkey = t.p_partkey")
def _(get):
    p = get("part").select("p_partkey", "p_name", "p_size")
    s = p.filter("p_partkey % 10 = 0").withColumn("p_name", F.concat("p_name", F.lit(" new"))).unionByName(p.filter("p_partkey % 50 = 0").withColumn("p_partkey", F.col("p_partkey") + 1000000))
    return D.merge(p, s, "p_partkey", {"p_name": F.col("s.p_name"), "p_size": F.col("s.p_size")})


@query("sql_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def _(get):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return get("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


# constructs with a text of their own in each engine
surface("sql_join_comma", "SELECT n_name, r_name, s_name FROM {nation} n, {region} r, {supplier} s WHERE n.n_regionkey = r.r_regionkey AND s.s_nationkey = n.n_nationkey")
surface("sql_join_outer_apply", D.rewrite("SELECT n_name, top.s_name FROM {nation} n OUTER APPLY (SELECT max(s_name) AS s_name FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey AND s_acctbal > 8000) top"),
    "SELECT n_name, (SELECT max(s_name) FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s_acctbal > 8000) AS s_name FROM nation n")
surface("sql_subq_all_empty", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_nationkey = c.c_nationkey AND s_acctbal > 5000 AND NOT coalesce(c.c_acctbal > s.s_acctbal, FALSE))",
    "SELECT c_custkey FROM customer c WHERE c.c_acctbal > ALL (SELECT s_acctbal FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s_acctbal > 5000)")
surface("sql_subq_any", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_nationkey = c.c_nationkey AND c.c_acctbal < s.s_acctbal)",
    "SELECT c_custkey FROM customer c WHERE c.c_acctbal < ANY (SELECT s_acctbal FROM supplier s WHERE s.s_nationkey = c.c_nationkey)")
surface("sql_agg_listagg_distinct", "SELECT n_regionkey, listagg(DISTINCT substring(n_name, 1, 1), ',') WITHIN GROUP (ORDER BY substring(n_name, 1, 1)) AS letters FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT substring(n_name, 1, 1))), ',') AS letters FROM nation GROUP BY n_regionkey")
surface("sql_json_object", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'n', n_name)) AS j FROM {nation}", "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'n', n_name) AS VARCHAR) AS j FROM nation")
surface("sql_json_objectagg", "SELECT n_regionkey, to_json(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))) AS j FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, concat('{{', string_agg(concat('\"', n_name, '\":', CAST(n_nationkey AS VARCHAR)), ',' ORDER BY n_name), '}}') AS j FROM nation GROUP BY n_regionkey")
surface("sql_json_table", "SELECT event_id, j.k FROM {events} LATERAL VIEW inline(from_json(concat('[', props, ',', props, ']'), 'array<struct<k:bigint>>')) j AS k", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events CROSS JOIN (VALUES (1), (2)) AS t(i)")
surface("sql_is_nan", "SELECT count(*) AS n FROM {supplier} WHERE isnan(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE CAST('NaN' AS DOUBLE) END)", "SELECT count(*) AS n FROM supplier WHERE NOT (s_acctbal > 0)")
surface("sql_as_of", "SELECT user_id, max_by(event_type, struct(ts, event_id)) AS state FROM {events} WHERE ts <= (SELECT min(ts) + INTERVAL 10 DAY FROM {events}) GROUP BY user_id",
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 10 DAY FROM events) GROUP BY user_id")
surface("sql_insert_first", "SELECT CASE WHEN o_totalprice > 300000 THEN 'BIG' WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'REST' END AS target, count(*) AS n FROM {orders} GROUP BY 1")
surface("sql_regexp_instr", "SELECT p_partkey, regexp_instr(p_name, 'e[a-z]') AS at FROM {part}", "SELECT p_partkey, CAST(CASE WHEN regexp_matches(p_name, 'e[a-z]') THEN instr(p_name, regexp_extract(p_name, 'e[a-z]')) ELSE 0 END AS INTEGER) AS at FROM part")
surface("sql_to_char", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd HH:mm') AS d FROM {orders}", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS d FROM orders")
