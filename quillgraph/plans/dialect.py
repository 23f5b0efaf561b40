"""Constructs of the recognised SQL dialect that Spark's parser lacks, as plans, and a rewriter for the textual ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def connect_by(edges: DataFrame, start: DataFrame, max_level: int = 100) -> DataFrame:
    """Hierarchical query without cycles: ``node, level, connect_root, path``; siblings come in the order of ``path``."""
    from ..operators.graph import path_tree

    tree = path_tree(edges, start, max_depth=max_level - 1).filter("not circular")
    return tree.select("node", (F.col("depth") + 1).alias("level"), F.col("root").alias("connect_root"), F.array_join("path", "/").alias("path"))


def fetch_first(df: DataFrame, order: list[Column], n: int | None = None, percent: float | None = None, ties: bool = False, offset: int = 0) -> DataFrame:
    """OFFSET and FETCH FIRST n ROWS or PERCENT, ONLY or WITH TIES. ONLY without percent is a plain limit, which needs no window."""
    if percent is None and not ties:
        return df.orderBy(*order).offset(offset).limit(n)
    w = W.orderBy(*order)
    rows = df.withColumns({"_n": F.row_number().over(w), "_r": F.rank().over(w)})
    last = F.lit(n + offset) if percent is None else F.ceil(F.lit(percent) / 100 * df.count()) + offset
    return rows.filter((F.col("_n") > offset) & (F.col("_r" if ties else "_n") <= last)).drop("_n", "_r")


def keep_dense(df: DataFrame, keys: list[str], order: list[Column], *aggs: Column) -> DataFrame:
    """KEEP (DENSE_RANK FIRST ORDER BY ...): aggregates over the rows that come first, all of them on a tie."""
    return df.withColumn("_r", F.rank().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").groupBy(*keys).agg(*aggs)


def ratio_to_report(value: Column, *keys: str) -> Column:
    return value / F.sum(value).over(W.partitionBy(*keys))


def merge(target: DataFrame, source: DataFrame, key: str, update: dict[str, Column], delete: Column | None = None) -> DataFrame:
    """MERGE: matched rows take ``update`` (columns ``s.*`` and ``t.*``) and go if ``delete`` holds; unmatched source rows are inserted."""
    t, s = target.alias("t"), source.alias("s")
    both = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    here, there = F.col(f"t.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()
    if delete is not None:
        both = both.filter(~(here & there & F.coalesce(delete, F.lit(False))))
    cols = [F.when(here & there, update[c]).when(here, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) if c in update else F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c) for c in target.columns]
    return both.select(*cols)


def outer_plus(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """``a.k = b.k(+)``: the marked side may be missing."""
    return left.join(right, on, "left")


def partitioned_outer(dim: DataFrame, facts: DataFrame, by: str, on: str) -> DataFrame:
    """Partitioned outer join: every dimension row for each partition of the facts, small sides crossed by intent."""
    return facts.select(by).distinct().crossJoin(F.broadcast(dim)).join(facts, [by, on], "left")


def multiset_except(a: Column, b: Column) -> Column:
    """MULTISET EXCEPT ALL of two arrays: each value as often as it is left over, sorted."""
    left = lambda x: F.size(F.filter(a, lambda y: y == x)) - F.size(F.filter(b, lambda y: y == x))
    return F.sort_array(F.flatten(F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(left(x), F.lit(0))))))


def multiset_intersect(a: Column, b: Column) -> Column:
    both = lambda x: F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))
    return F.sort_array(F.flatten(F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, both(x)))))


def strict_least(*cols: Column) -> Column:
    """LEAST of the dialect: null if any value is null."""
    some = cols[0].isNull()
    for c in cols[1:]:
        some = some | c.isNull()
    return F.when(~some, F.least(*cols))


REWRITES = (
    (r"(?i)\bFROM\s+DUAL\b", ""), (r"(?i)\bMINUS\b", "EXCEPT"), (r"(?i)\bSYSDATE\b|\bSYSTIMESTAMP\b", "current_timestamp()"),
    (r"(?i)\bCROSS\s+APPLY\s*\(", "CROSS JOIN LATERAL ("), (r"(?i)\bOUTER\s+APPLY\s*(\((?:[^()]|\([^()]*\))*\))\s*(\w+)", r"LEFT JOIN LATERAL \1 \2 ON TRUE"),
    (r"(?i)\bFETCH\s+(?:FIRST|NEXT)\s+(\d+)\s+ROWS?\s+ONLY\b", r"LIMIT \1"), (r"(?i)\bOFFSET\s+(\d+)\s+ROWS?\b(.*?)(LIMIT\s+\d+)", r"\3 OFFSET \1"),
    (r"(?i)\bSYS_GUID\s*\(\s*\)", "uuid()"), (r"(?i)\^=", "<>"), (r"(?i)\bRAWTOHEX\s*\(", "hex("), (r"(?i)\bHEXTORAW\s*\(", "unhex("), (r"(?i)\bORA_HASH\s*\(", "hash("),
    (r"(?i)\bRATIO_TO_REPORT\s*\(\s*([\w.]+)\s*\)\s*OVER\s*\(([^()]*)\)", r"(\1 / sum(\1) OVER (\2))"),
)


def rewrite(text: str) -> str:
    """Dialect text to Spark SQL, outside of string literals."""
    parts = re.split(r"('(?:[^']|'')*')", text)
    for i in range(0, len(parts), 2):
        for pattern, new in REWRITES:
            parts[i] = re.sub(pattern, new, parts[i])
    return "".join(parts)
