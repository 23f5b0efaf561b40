"""Telling rows by a large set of keys without shuffling the rows that are clearly not in it.

A bitmap of key hashes has 16 bits for each key, between ``LEAST_BITS`` and ``MOST_BITS`` as powers of two (64 MB at most), whatever
the input. It never misses a key; rows that it lets through wrongly are told apart by an exact join. Beyond 2**25 keys it lets
more and more through, which costs a shuffle of those rows and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_kernel as K
from .runtime import partitions, prepare

LEAST_BITS, MOST_BITS, SEGMENT_BITS = 12, 29, 6
SCHEMA = "segment int, data binary"


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _marks(bits: int):
    """The distinct places of a task's keys, by segment of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(b.column("key").to_numpy(), bits))
            edge = np.searchsorted(at >> (bits - SEGMENT_BITS), np.arange((1 << SEGMENT_BITS) + 1))
            out = [(s, K.pack(K.put_varints(np.diff(at[edge[s] : edge[s + 1]] & ((1 << (bits - SEGMENT_BITS)) - 1), prepend=0))[0])) for s in np.flatnonzero(np.diff(edge)).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["segment", "data"])

    return run


def _merged(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column("segment").to_pylist(), b.column("data").to_pylist(), strict=True):
                held.setdefault(s, np.zeros(1 << (bits - SEGMENT_BITS), bool))[np.cumsum(K.get_varints(K.unpack(x)[0])[0])] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([K.pack(np.packbits(x)) for x in held.values()], pa.binary())], ["segment", "data"])

    return run


def bitmap(keys: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of a place, and the packed bitmap, of a table with one column ``key`` (long, no nulls)."""
    spark = prepare(keys.sparkSession)
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    n = min(1 << SEGMENT_BITS, partitions(spark))
    rows = keys.mapInArrow(_marks(bits), SCHEMA).repartitionById(n, F.col("segment") % n).mapInArrow(_merged(bits), SCHEMA).collect()  # of bounded size
    out = np.zeros((1 << SEGMENT_BITS, 1 << (bits - SEGMENT_BITS - 3)), np.uint8)
    for r in rows:
        out[r["segment"]] = K.unpack(bytes(r["data"]))[0]
    return bits, out.ravel()


def maybe(keys: DataFrame, key: Column) -> Column:
    """Whether ``key`` (long; null is in no set) may be among ``keys(key)``: only the key leaves the JVM."""
    bits, marks = bitmap(keys)
    held = keys.sparkSession.sparkContext.broadcast(marks.tobytes())  # 64 MB at most

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.frombuffer(held.value, np.uint8)
        for x in batches:
            known = x.notna().to_numpy()
            at = _places(x.fillna(0).to_numpy(), bits)
            yield pd.Series(known & ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0))

    return run(key)


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with names by place, which clash with nothing, and these names."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def without(rows: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """``rows`` whose ``keys`` are not a row of ``gone`` (the same columns). Rows with a null key stay. Only rows that the bitmap
    lets through meet ``gone`` in a join."""
    mark = maybe(gone.select(F.xxhash64(*keys).alias("key")), F.xxhash64(*keys))
    told = rows.withColumn("_maybe", mark)
    return told.filter("not _maybe").drop("_maybe").unionByName(told.filter("_maybe").drop("_maybe").join(gone, keys, "left_anti"))


def only(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """``rows`` joined with ``wanted`` on ``keys``; rows that are clearly not wanted stay out of the shuffle."""
    mark = maybe(wanted.select(F.xxhash64(*keys).alias("key")), F.xxhash64(*keys))
    return rows.filter(mark).join(wanted, keys)
