"""Reproducible global shuffle into shards with a computable place for every row.

Rows are numbered without gaps in the order of (id, text hash, size); a Feistel network over the next power of two, with
cycle walking back into the range, permutes the numbers. Row ``r`` goes to shard ``p(r) mod shards`` at slot
``p(r) div shards``: counts differ by one at most, slots have no gaps, and ``place`` and ``origin`` compute either
way from (seed, rows, shards) alone, without the table. Law: ``rows``.

A null text has size 1 and the CRC of no bytes; a null id sorts first; rows alike in every read column are alike in the
result, whichever of them gets which number. The length of a text has no bearing on memory: only its size and CRC are kept. An empty
table gives an empty result. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import narrowed, partitions, prepare, stored

#: Feistel rounds.
ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x ^ _U(key & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _keys(seed: int) -> list[int]:
    return [((seed * 2 + 1) * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & (2**64 - 1) for k in range(ROUNDS)]


def _halves(rows: int) -> tuple[int, int]:
    """Bits of the left and right half of the smallest power of two that holds ``rows``, two bits at least."""
    bits = max(2, (rows - 1).bit_length())
    return bits // 2, bits - bits // 2


def _rounds(x: np.ndarray, a: int, b: int, keys: list[int], back: bool) -> np.ndarray:
    """The network over a + b bits; odd rounds change the left part, even ones the right, so halves may differ in size."""
    left, right = x >> _U(b), x & _U((1 << b) - 1)
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if k % 2:
            left = left ^ (_mix(right, keys[k]) & _U((1 << a) - 1))
        else:
            right = right ^ (_mix(left, keys[k]) & _U((1 << b) - 1))
    return (left << _U(b)) | right


def permute(numbers: np.ndarray, rows: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of 0..rows-1 at ``numbers``, or its inverse. Walks the cycle until the value is in range."""
    a, b = _halves(rows)
    keys, out = _keys(seed), np.array(numbers, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _rounds(out[todo], a, b, keys, back)
        todo = todo[out[todo] >= _U(rows)]
    return out.astype(np.int64)


def place(number: int, rows: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([number]), rows, seed)[0])
    return p % shards, p // shards


def origin(shard: int, slot: int, rows: int, shards: int, seed: int = 0) -> int:
    """The row number that is at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), rows, seed, back=True)[0])


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` 0, 1, ... in global order, and the number of rows.

    A range exchange sorts; only the counts of the partitions come to the driver.
    """
    spark = df.sparkSession
    n = max(1, min(partitions(spark), 4096))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    held = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    counts = held.groupBy(F.shiftright("_at", 33).alias("part")).count().collect()
    start, before = 0, {}
    for part, count in sorted((r["part"], r["count"]) for r in counts):
        before[part], start = start, start + count
    if not before:
        return held.withColumn("row_number", F.col("_at")).drop("_at"), 0
    starts = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    return held.withColumn("row_number", starts[F.shiftright("_at", 33)] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"), start


def permuted(number: Column, rows: int, seed: int = 0) -> Column:
    """The permutation as a column."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(permute(x.to_numpy(), rows, seed))

    return run(number)


def shard(docs: DataFrame, shards: int = 16, *, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number`` for every row."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = narrowed(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, total = numbered(narrow, "doc_id", "text_crc32", "size")
    at = rows.withColumn("_p", permuted(F.col("row_number"), max(total, 1), seed))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"),
        F.expr(f"_p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
