"""Roll-ups of code facts. Sets come out as sorted, comma-joined strings; "first" is by an explicit order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import DETECT_PRIORITY, ROLL_UP_PRIORITY, rank_of


def joined(c: Column | str) -> Column:
    """A set as text."""
    return F.array_join(F.sort_array(F.collect_set(c)), ",")


def table_rollup(access: DataFrame) -> DataFrame:
    """Accesses by table (upper-cased): one detail for each procedure, table, operation and line, whatever the schema."""
    once = access.withColumn("tbl", F.upper("tbl")).select("proc", "tbl", "op", "line").distinct()
    return once.groupBy("tbl").agg(joined("op").alias("ops"), F.count("*").alias("n_details"), F.countDistinct("proc").alias("n_procs"))


def join_pair_rollup(joins: DataFrame) -> DataFrame:
    """Joins by unordered pair of tables: types, uses, and the orientation seen first."""
    low, high = F.least("left_tbl", "right_tbl").alias("tbl_a"), F.greatest("left_tbl", "right_tbl").alias("tbl_b")
    first = F.min_by(F.concat_ws(">", "left_tbl", "right_tbl"), F.struct("ord", "right_tbl"))
    return joins.groupBy(low, high).agg(joined("type").alias("types"), F.count("*").alias("n_uses"), first.alias("first_orientation"))


def cursor_rollup(cursors: DataFrame) -> DataFrame:
    """Cursors by name: operations, and the type seen first that is not null, EXPLICIT by default."""
    kind = F.coalesce(F.min_by("type", F.when(F.col("type").isNotNull(), F.col("ord"))), F.lit("EXPLICIT"))
    return cursors.groupBy("name").agg(kind.alias("type"), joined("op").alias("ops"), F.count("*").alias("n_uses"))


def sequence_rollup(uses: DataFrame) -> DataFrame:
    return uses.groupBy(F.upper("name").alias("name")).agg(joined("op").alias("ops"), F.countDistinct("proc").alias("n_procs"), F.count("*").alias("n_uses"))


def ops_lines(access: DataFrame, *keys: str) -> DataFrame:
    """Two levels: table, then operation with its distinct lines in order."""
    return access.groupBy(*keys, "tbl", "op").agg(F.array_join(F.sort_array(F.collect_set("line")), ",").alias("lines"), F.countDistinct("line").alias("n_lines"))


def call_group(calls: DataFrame) -> DataFrame:
    """Calls by caller and target, built-ins left out: count and lines."""
    return calls.filter("type <> 'BUILTIN'").groupBy("caller", "callee").agg(F.min_by("type", "ord").alias("type"), F.count("*").alias("n_calls"), F.array_join(F.sort_array(F.collect_set("line")), ",").alias("lines"))


def calls_out_split(calls: DataFrame) -> DataFrame:
    """Distinct targets by caller, inside and outside; whatever is not INTERNAL counts as outside."""
    inside = F.col("type") == "INTERNAL"
    return calls.groupBy("caller").agg(F.countDistinct(F.when(inside, F.col("callee"))).alias("n_internal"), F.countDistinct(F.when(~inside, F.col("callee"))).alias("n_external"))


def edge_dedup(edges: DataFrame) -> DataFrame:
    """Edges once: calls, least depth, lines."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("depth").alias("depth"), F.array_join(F.sort_array(F.collect_set("line")), ",").alias("lines"))


def op_histogram(access: DataFrame) -> DataFrame:
    """Number of tables for each operation."""
    return access.select("tbl", "op").distinct().groupBy("op").agg(F.count("*").alias("n_tables")).orderBy(F.desc("n_tables"), "op")


def endpoint_totals(usage: DataFrame) -> DataFrame:
    """One row for each endpoint with its collections, operations and the operation of highest priority."""
    return usage.groupBy("endpoint").agg(
        F.count("*").alias("n_uses"), F.countDistinct("collection").alias("n_collections"), joined("op").alias("ops"),
        F.count_if(F.col("op").isin("WRITE", "UPDATE", "DELETE")).alias("n_writes"), F.max_by("op", rank_of(F.col("op"), ROLL_UP_PRIORITY)).alias("best_op"),
    )


def coll_first_op(usage: DataFrame) -> DataFrame:
    return usage.groupBy("endpoint", "collection").agg(F.min_by("op", "ord").alias("op"))


def coll_best_op(usage: DataFrame, ranking: tuple[str, ...] = ROLL_UP_PRIORITY) -> DataFrame:
    return usage.groupBy("endpoint", "collection").agg(F.max_by("op", rank_of(F.col("op"), ranking)).alias("op"))


def detected_op(usage: DataFrame) -> DataFrame:
    """The other order, for operations that a detector saw; CALL is in none."""
    return coll_best_op(usage, DETECT_PRIORITY)


def session_stats(log: DataFrame) -> DataFrame:
    """Calls by session: totals, whole average, errors (anything but true), first and last time."""
    return log.groupBy("session").agg(
        F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.expr("sum(ms) div count(*)").alias("avg_ms"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def histogram_with_zeros(rows: DataFrame, by: Column, labels: tuple[str, ...]) -> DataFrame:
    """Counts by label, also of labels that do not occur."""
    all_labels = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return all_labels.join(rows.groupBy(by.alias("label")).agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def coll_op_pivot(usage: DataFrame) -> DataFrame:
    """Uses of each collection by kind of operation; reads and counts are one kind."""
    kinds = ["AGGREGATE", "DELETE", "READ", "UPDATE", "WRITE"]
    kind = F.when(F.col("op") == "COUNT", "READ").otherwise(F.col("op"))
    wide = usage.withColumn("kind", kind).groupBy("collection").pivot("kind", kinds).agg(F.count(F.lit(1)))
    return wide.select("collection", *[F.coalesce(k, F.lit(0)).alias(f"n_{k.lower()}") for k in kinds])


def domain_crossing(usage: DataFrame) -> DataFrame:
    """Collections that endpoints of more than one domain use."""
    return usage.groupBy("collection").agg(F.countDistinct("domain").alias("n_domains"), joined("domain").alias("domains")).filter("n_domains > 1")


def complexity(usage: DataFrame) -> DataFrame:
    """Weighted score of each collection and its class."""
    has = lambda *ops: F.countDistinct(F.when(F.col("op").isin(*ops), F.col("op")))
    score = (
        F.countDistinct("endpoint") * 1.0 + has("READ", "COUNT", "AGGREGATE") * 0.5 + has("WRITE", "UPDATE", "DELETE") * 1.5 + has("AGGREGATE") * 2.0
        + F.greatest(F.lit(0), F.countDistinct("domain") - 1) * 3.0 + F.max(F.when(F.col("source") == "PIPELINE_RUNTIME", 2.0).otherwise(0.0)) + F.count("*") * 0.3
    )
    rows = usage.groupBy("collection").agg(F.round(score, 2).alias("score"))
    return rows.withColumn("class", F.when(F.col("score") <= 4, "Low").when(F.col("score") <= 10, "Medium").otherwise("High"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """Per-chunk corrections of a node as one: set unions."""
    return chunks.groupBy("node").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))), ",").alias("items"), F.count("*").alias("n_chunks"))
