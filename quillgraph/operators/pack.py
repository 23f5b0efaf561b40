"""Size budgets: chunk plans, bin packing of neighbours, history purge, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .resolve import pick_first


def chunk_plan(sizes: DataFrame, chars: int = 50_000, nodes: int = 500) -> DataFrame:
    """Whole if a tree is within both limits, else a skeleton with branches."""
    whole = (F.col("chars") <= chars) & (F.col("nodes") <= nodes)
    return sizes.withColumn("plan", F.when(whole, "WHOLE").otherwise("SPLIT")).withColumn("parts", F.when(whole, F.lit(1).cast("long")).otherwise(F.greatest(F.ceil(F.col("chars") / chars), F.ceil(F.col("nodes") / nodes))))


def chunk_dedup(chunks: DataFrame) -> DataFrame:
    """The largest chunk of each label; on a tie the first."""
    return pick_first(chunks, ["label"], F.desc("size"), "ord")


def bin_pack(seq: DataFrame, limit: int, *keys: str) -> DataFrame:
    """Neighbours in order share a bin up to a limit; a larger piece has its own. Within each key a fold over its pieces."""
    start = F.struct(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<ord:bigint,bin:bigint>>").alias("out"))

    def step(s, x):
        opens = (s["used"] > 0) & (s["used"] + x["size"] > limit)
        at = s["bin"] + F.when(opens, 1).otherwise(0)
        return F.struct(at.alias("bin"), F.when(opens, x["size"]).otherwise(s["used"] + x["size"]).alias("used"), F.concat(s["out"], F.array(F.struct(x["ord"].alias("ord"), at.alias("bin")))).alias("out"))

    g = seq.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("size").cast("long").alias("size")))).alias("all"))
    return g.select(*keys, F.inline(F.aggregate("all", start, step, lambda s: s["out"])))


def history_purge(lines: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The newest lines whose sizes, newest first, stay within a limit of each key."""
    w = W.partitionBy(*keys).orderBy(F.desc("ord")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("running", F.sum("size").over(w)).filter(F.col("running") <= limit)


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """A page of a listing."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
