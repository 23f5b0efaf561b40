"""Classification ladders and scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import rollup
from ..registry import query


@query("call_classify", """SELECT caller, callee, n, CASE WHEN n % 3 = 0 THEN CASE WHEN callee IN ('view', 'click') THEN 'INTERNAL' WHEN callee = 'error' THEN 'BUILTIN' ELSE 'EXTERNAL' END
    WHEN n % 3 = 1 THEN CASE WHEN n % 2 = 0 THEN 'INTERNAL' ELSE 'BUILTIN' END ELSE 'EXTERNAL' END AS cls
    FROM (SELECT caller, callee, count(*) AS n FROM {call} GROUP BY caller, callee)""")
def _(get):
    """Names of one, two and three parts."""
    g = get("call").groupBy("caller", "callee").agg(F.count("*").alias("n"))
    parts = F.when(F.col("n") % 3 == 0, F.array("callee")).when(F.col("n") % 3 == 1, F.array(F.when(F.col("n") % 2 == 0, F.lit("OWN")).otherwise("DBMS_X"), F.col("callee"))).otherwise(F.array(F.lit("S"), F.lit("P"), F.col("callee")))
    return g.select("caller", "callee", "n", C.call_class(parts, F.lit("OWN"), F.array(F.lit("view"), F.lit("click")), ("error",)).alias("cls"))


@query("edge_call_type", """SELECT src, dst, CASE WHEN ord % 7 = 0 THEN 'DYNAMIC' WHEN ord % 11 = 0 THEN 'TRIGGER' WHEN dst = src OR starts_with(dst, 'N1') THEN 'INTERNAL' ELSE 'EXTERNAL' END AS type FROM {edge_dag}""")
def _(get):
    e = get("edge_dag").withColumn("target", F.when((F.col("dst") == F.col("src")) | F.col("dst").startswith("N1"), F.concat(F.lit("PK."), "dst")).otherwise(F.col("dst")))
    return e.select("src", "dst", C.edge_call_type(F.col("ord") % 7 == 0, F.col("ord") % 11 == 0, F.col("target"), F.lit("PK")).alias("type"))


@query("sql_op_infer", """SELECT id, CASE WHEN regexp_matches(upper(ltrim(sql)), '^(SELECT|WITH)') THEN 'READ' WHEN regexp_matches(upper(ltrim(sql)), '^(INSERT|MERGE)') THEN 'WRITE'
    WHEN regexp_matches(upper(ltrim(sql)), '^UPDATE') THEN 'UPDATE' WHEN regexp_matches(upper(ltrim(sql)), '^(DELETE|TRUNCATE)') THEN 'DELETE'
    WHEN regexp_matches(upper(ltrim(sql)), '^(.?.?CALL|EXEC|BEGIN)') THEN 'CALL' END AS op FROM {sql_text}""")
def _(get):
    return get("sql_text").select("id", C.sql_operation(F.col("sql")).alias("op"))


VERBS = "findAllById getName saveAll updateFirst removeAll countByX existsById aggregateX groupBy doWork insertOne DeleteMany listAll incrementCounter facetBy scrollAll bulkWriteAll unwindX watchIt mapReduceX aggregation addListener createLogger setName getSession resolveIt outTo putDocumentX mutateX".split()
NAMES = "SELECT v AS name, p_type AS part, CASE p_type WHEN 'ECONOMY' THEN 'ENTITY' WHEN 'PROMO' THEN 'OTHER' WHEN 'STANDARD' THEN 'SERVICE' WHEN 'SMALL' THEN 'REPOSITORY' END AS role FROM (SELECT DISTINCT p_type FROM {part}) CROSS JOIN (VALUES %s) AS t(v)" % ", ".join(f"('{v}')" for v in VERBS)
OPS = "|".join(C.OTHER_SUFFIXES)


def any_of(op, bare):
    return "^(%s)" % "|".join(w.lower() for w in C.OP_PREFIXES[op] if (w in C.ACCESSORS) != bare)


@query("op_from_name", f"SELECT name, part, CASE WHEN regexp_matches(lower(name), '({OPS})$') THEN NULL " + " ".join(
    f"WHEN regexp_matches(lower(name), '{any_of(op, True)}')" + (f" OR (regexp_matches(lower(name), '{any_of(op, False)}') AND role IN ('SERVICE', 'REPOSITORY'))" if set(w) & set(C.ACCESSORS) else "") + f" THEN '{op}'" for op, w in C.OP_PREFIXES.items()) + f" END AS op FROM ({NAMES})")
def _(get):
    """By prefix, without names that end in another purpose; accessors count only outside data classes."""
    return get.sql(NAMES).select("name", "part", C.op_from_name(F.col("name"), F.col("role")).alias("op"))


PREFIXES = "(VALUES ('COLL_1', 'Claims', 1), ('COLL_12', 'Policy', 1), ('COLL_2', 'Accounting', 2), ('COLL_', 'General', 3), ('COLL_1', 'Late', 3)) AS p(prefix, domain, level)"


@query("domain_prefix", f"""SELECT collection, coalesce(domain, 'Other') AS domain FROM (SELECT collection, domain, row_number() OVER (PARTITION BY collection ORDER BY level, length(prefix) DESC) AS r
    FROM (SELECT DISTINCT collection FROM {{usage}}) LEFT JOIN {PREFIXES} ON starts_with(collection, prefix)) WHERE r = 1""")
def _(get):
    """The domain of a collection: lowest level first, in it the longest prefix. Prefixes are cut from the name, so the join is by equality."""
    names = get("usage").select("collection").distinct()
    cuts = names.select("collection", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("collection")), lambda i: F.substring("collection", F.lit(1), i))).alias("prefix"))
    found = cuts.join(get.spark.sql(f"SELECT * FROM {PREFIXES}"), "prefix")
    best = found.groupBy("collection").agg(F.min_by("domain", F.struct("level", -F.char_length("prefix"))).alias("domain"))
    return names.join(best, "collection", "left").select("collection", F.coalesce("domain", F.lit("Other")).alias("domain"))


@query("stereotype", """SELECT p_type, CASE p_type WHEN 'ECONOMY' THEN 'SERVICE' WHEN 'STANDARD' THEN 'CONTROLLER' ELSE CASE WHEN ends_with(p_type, 'O') THEN 'REPOSITORY' ELSE 'OTHER' END END AS stereotype FROM part GROUP BY p_type""")
def _(get):
    """By annotation first, then by the suffix of an interface."""
    by_note = F.create_map(F.lit("ECONOMY"), F.lit("SERVICE"), F.lit("STANDARD"), F.lit("CONTROLLER"))[F.col("p_type")]
    return get("part").select("p_type").distinct().select("p_type", F.coalesce(by_note, F.when(F.col("p_type").endswith("O"), "REPOSITORY").otherwise("OTHER")).alias("stereotype"))


ARCHIVES = "SELECT DISTINCT concat(lower(p_type), '-', CASE p_partkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'billing-service' ELSE 'web-app' END, '-', CAST(p_size AS VARCHAR(9)), '.0.1', CASE p_partkey % 2 WHEN 0 THEN '-SNAPSHOT' ELSE '' END, '.jar') AS archive FROM {part}"


@query("jar_label", f"""SELECT archive, array_to_string(list_transform(list_filter(string_split(regexp_replace(archive, '(-[0-9][0-9.]*(-SNAPSHOT)?)?[.]jar$', ''), '-'), lambda x: x NOT IN ('extension', 'core', 'lib', 'common', 'shared', 'service', 'module', 'app')),
    lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM ({ARCHIVES})""")
def _(get):
    """A label from an archive's name: version off, filler segments off, words capitalised."""
    return get.sql(ARCHIVES).select("archive", C.archive_label(F.col("archive")).alias("label"))


@query("var_category", """SELECT v, CASE WHEN ends_with(upper(v), '%ROWTYPE') THEN 'ROWTYPE' WHEN ends_with(upper(v), '%TYPE') THEN 'TYPE' WHEN regexp_matches(upper(v), '\\b(TABLE|VARRAY)\\b|^T_.*(TAB|LIST)$') THEN 'COLLECTION' ELSE 'PLAIN' END AS category
    FROM (VALUES ('emp%ROWTYPE'), ('emp.id%type'), ('NUMBER'), ('t_id_tab'), ('TABLE OF NUMBER'), ('VARRAY(10) OF DATE'), ('VARCHAR2(30)')) AS t(v)""")
def _(get):
    rows = get.spark.createDataFrame([(x,) for x in ("emp%ROWTYPE", "emp.id%type", "NUMBER", "t_id_tab", "TABLE OF NUMBER", "VARRAY(10) OF DATE", "VARCHAR2(30)")], "v string")
    return rows.select("v", C.variable_category(F.col("v")).alias("category"))


JOINS = (("JOIN", "INNER"), ("LEFT JOIN", "LEFT OUTER"), ("left outer join", "LEFT OUTER"), ("RIGHT OUTER  JOIN", "RIGHT OUTER"), ("FULL JOIN", "FULL OUTER"), ("CROSS JOIN", "CROSS"), ("NATURAL JOIN", "NATURAL"), ("Cross Apply", "CROSS APPLY"), ("OUTER APPLY", "OUTER APPLY"), (",", "IMPLICIT"))
JOINED = "SELECT p_partkey AS id, concat(p_type, '_left ', CASE p_partkey %% 10 %s END, ' joined_', CAST(p_size AS VARCHAR(9))) AS j FROM {part}" % " ".join(f"WHEN {i} THEN '{w}'" for i, (w, _) in enumerate(JOINS))


@query("join_type", "SELECT p_partkey AS id, CASE p_partkey %% 10 %s END AS type FROM part" % " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(JOINS)))
def _(get):
    """Kind of a join by the words between two names; names that hold such words do not count."""
    return get.sql(JOINED).select("id", C.join_type(F.col("j")).alias("type"))


@query("op_priority", "SELECT DISTINCT op, CASE op WHEN 'COUNT' THEN 1 WHEN 'AGGREGATE' THEN 2 WHEN 'READ' THEN 3 WHEN 'DELETE' THEN 4 WHEN 'UPDATE' THEN 5 WHEN 'WRITE' THEN 6 ELSE 0 END AS priority FROM {usage}")
def _(get):
    return get("usage").select("op").distinct().select("op", C.rank_of(F.col("op"), C.ROLL_UP_PRIORITY).alias("priority"))


@query("size_class", "SELECT CASE WHEN methods <= 5 THEN 'S' WHEN methods <= 20 THEN 'M' WHEN methods <= 50 THEN 'L' ELSE 'XL' END AS size, count(*) AS n FROM {endpoint} GROUP BY 1")
def _(get):
    return get("endpoint").groupBy(C.size_class(F.col("methods")).alias("size")).agg(F.count("*").alias("n"))


@query("perf_class", "SELECT CASE WHEN db_ops <= 0 THEN 'No Impact' WHEN db_ops <= 5 THEN 'Low Impact' WHEN db_ops <= 20 THEN 'Medium Impact' ELSE 'High Impact' END AS perf, count(*) AS n FROM {endpoint} GROUP BY 1")
def _(get):
    return get("endpoint").groupBy(C.perf_class(F.col("db_ops")).alias("perf")).agg(F.count("*").alias("n"))


@query("complexity_score", """SELECT collection, score, CASE WHEN score <= 4 THEN 'Low' WHEN score <= 10 THEN 'Medium' ELSE 'High' END AS class FROM (SELECT collection, round(count(DISTINCT endpoint) * 1.0
    + count(DISTINCT CASE WHEN op IN ('READ', 'COUNT', 'AGGREGATE') THEN op END) * 0.5 + count(DISTINCT CASE WHEN op IN ('WRITE', 'UPDATE', 'DELETE') THEN op END) * 1.5 + count(DISTINCT CASE WHEN op = 'AGGREGATE' THEN op END) * 2.0
    + greatest(0, count(DISTINCT domain) - 1) * 3.0 + max(CASE WHEN source = 'PIPELINE_RUNTIME' THEN 2.0 ELSE 0.0 END) + count(*) * CAST(0.3 AS DOUBLE), 2) AS score FROM {usage} GROUP BY collection)""")
def _(get):
    return rollup.complexity(get("usage"))


COLLECTIONS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(upper(p_type), '_V_', CAST(p_size AS VARCHAR(9))) WHEN 1 THEN concat('sb_', p_type) WHEN 2 THEN concat(p_type, '_vi_x') ELSE concat('DATA_', p_type) END AS name FROM {part}"


@query("view_detect", f"SELECT p_partkey, name, p_partkey % 4 < 3 AS is_view FROM ({COLLECTIONS})")
def _(get):
    """A view by the marks in a collection's name."""
    return get.sql(COLLECTIONS).select("p_partkey", "name", C.view_name(F.col("name")).alias("is_view"))


@query("batch_keyword", "SELECT conv_id, turn, regexp_matches(lower(text), 'batch|job|schedul|cron|async|bulk|process|trigger|task') AS batch FROM conversations")
def _(get):
    return get("conversations").select("conv_id", "turn", F.lower("text").rlike("|".join(C.BATCH_WORDS)).alias("batch"))


@query("txn_requirement", """SELECT endpoint, CASE WHEN w > 1 THEN 'REQUIRED' WHEN w = 1 AND n > 1 THEN 'ADVISORY' ELSE 'NONE' END AS txn
    FROM (SELECT endpoint, count(DISTINCT CASE WHEN op IN ('WRITE', 'UPDATE', 'DELETE') THEN split_part(collection, '_', 2)[1:1] END) AS w, count(DISTINCT split_part(collection, '_', 2)[1:1]) AS n FROM {usage} GROUP BY endpoint)""")
def _(get):
    """By the domains that an endpoint writes to and touches; the first digit of a collection's number is its domain here."""
    domain = F.substring(F.split("collection", "_")[1], 1, 1)
    writes = F.countDistinct(F.when(F.col("op").isin("WRITE", "UPDATE", "DELETE"), domain)).alias("w")
    g = get("usage").groupBy("endpoint").agg(writes, F.countDistinct(domain).alias("n"))
    return g.select("endpoint", F.when(F.col("w") > 1, "REQUIRED").when((F.col("w") == 1) & (F.col("n") > 1), "ADVISORY").otherwise("NONE").alias("txn"))


@query("tech_detect", """SELECT endpoint, CASE WHEN bool_or(source = 'REPOSITORY_MAPPING') AND bool_or(source = 'PIPELINE_RUNTIME') THEN 'BOTH' WHEN bool_or(source = 'REPOSITORY_MAPPING') THEN 'JPA' WHEN bool_or(source = 'PIPELINE_RUNTIME') THEN 'MONGO' ELSE 'NONE' END AS tech FROM {usage} GROUP BY endpoint""")
def _(get):
    g = get("usage").groupBy("endpoint").agg(F.bool_or(F.col("source") == "REPOSITORY_MAPPING").alias("j"), F.bool_or(F.col("source") == "PIPELINE_RUNTIME").alias("m"))
    return g.select("endpoint", F.when(F.col("j") & F.col("m"), "BOTH").when(F.col("j"), "JPA").when(F.col("m"), "MONGO").otherwise("NONE").alias("tech"))


UNITS = (("CREATE OR REPLACE PACKAGE  BODY ", "PACKAGE_BODY"), ("package ", "PACKAGE"), ("create procedure ", "PROCEDURE"), ("function ", "FUNCTION"), (" CREATE TRIGGER ", "TRIGGER"), ("create or replace view ", "VIEW"), ("BEGIN trigger_", "ANONYMOUS"), ("create type body ", "TYPE_BODY"), ("Create Type ", "TYPE"))
HEADERS = "SELECT p_partkey AS id, concat(CASE p_partkey %% 9 %s END, lower(p_type), '_package IS procedure x;') AS src FROM {part}" % " ".join(f"WHEN {i} THEN '{w}'" for i, (w, _) in enumerate(UNITS))


@query("unit_type", "SELECT p_partkey AS id, CASE p_partkey %% 9 %s END AS unit FROM part" % " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(UNITS)))
def _(get):
    """Kind of unit by the header of its source."""
    return get.sql(HEADERS).select("id", C.unit_type(F.col("src")).alias("unit"))


DESCRIBED = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN concat('trg_', event_type, ' before insert on t') WHEN 1 THEN concat('AFTER UPDATE OF ', event_type) WHEN 2 THEN 'instead of delete' WHEN 3 THEN 'odd' END AS description,
    CASE event_id % 3 WHEN 0 THEN 'AFTER STATEMENT' WHEN 1 THEN 'BEFORE EACH ROW' END AS type FROM {events}"""


@query("trigger_timing", "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'BEFORE' WHEN 1 THEN 'AFTER' WHEN 2 THEN 'INSTEAD OF' ELSE CASE event_id % 3 WHEN 0 THEN 'AFTER' WHEN 1 THEN 'BEFORE' END END AS timing FROM events")
def _(get):
    return get.sql(DESCRIBED).select("id", C.trigger_timing(F.col("description"), F.col("type")).alias("timing"))


@query("catalog_verify", """SELECT collection, CASE WHEN collection IN (SELECT concat('COLL_', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_nationkey < 15) THEN 'VERIFIED'
    WHEN lower(collection) IN (SELECT concat('coll_', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_nationkey < 20) THEN 'VERIFIED_CASE' ELSE 'NOT_IN_DB' END AS state FROM (SELECT DISTINCT collection FROM {usage})""")
def _(get):
    """Exact names first, then names in the other case."""
    cat = get("nation").select(F.concat(F.when(F.col("n_nationkey") < 15, "COLL_").otherwise("coll_"), F.col("n_nationkey").cast("string")).alias("name"), "n_nationkey").filter("n_nationkey < 20")
    u = get("usage").select("collection").distinct()
    exact = cat.select(F.col("name").alias("collection"), F.lit(True).alias("exact"))
    other = cat.select(F.upper("name").alias("collection"), F.lit(True).alias("other")).distinct()
    return u.join(exact, "collection", "left").join(other, "collection", "left").select("collection", F.when(F.col("exact"), "VERIFIED").when(F.col("other"), "VERIFIED_CASE").otherwise("NOT_IN_DB").alias("state"))


@query("verification_fold", """SELECT k, coalesce(max_by(v, ord) FILTER (v IN ('ADDED', 'VERIFIED')), min_by(v, ord) FILTER (v = 'REMOVED')) AS state FROM (SELECT event_id % 60 AS k, event_id AS ord,
    CASE event_type WHEN 'view' THEN 'ADDED' WHEN 'click' THEN 'VERIFIED' ELSE 'REMOVED' END AS v FROM events) GROUP BY k""")
def _(get):
    """States in order: one replaces another if that is missing, or if it is a state other than REMOVED."""
    e = get("events").select((F.col("event_id") % 60).alias("k"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "view", "ADDED").when(F.col("event_type") == "click", "VERIFIED").otherwise("REMOVED").alias("v"))
    fold = F.aggregate(F.sort_array(F.collect_list(F.struct("ord", "v"))), F.lit(None).cast("string"), lambda s, x: F.when(s.isNull() | (x["v"] != "REMOVED"), x["v"]).otherwise(s))
    return e.groupBy("k").agg(fold.alias("state"))


@query("mixed_ranking", "SELECT collection, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS place FROM {usage} GROUP BY collection")
def _(get):
    g = get("usage").groupBy("collection").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.rank().over(W.orderBy(F.desc("n"))))
