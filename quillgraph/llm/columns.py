"""Column helpers in built-in functions only: bound values, prefix sums, spans of matches, exact binomial bounds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word in Java's regular expressions, and white space between words.
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of long by doubling: a pass for each power of two below the array's size."""

    def double(x: Column, step: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0).cast("long"), step), F.slice(x, 1, F.size(x) - step))
        return F.zip_with(x, moved, lambda a, b: a + b)

    steps = lambda x: F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(x))
    return let(values, lambda x: F.aggregate(steps(x), x, double))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches comes from splitting by the same pattern; running sums of lengths give the places.
    """
    rx = F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    between = F.split(text, pattern, -1)
    steps = lambda b, m: F.zip_with(F.slice(b, 1, F.size(m)), F.concat(F.array(F.lit("")), F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))), lambda x, y: (F.char_length(x) + F.char_length(y)).cast("long"))
    spans = let(found, lambda m: F.zip_with(prefix_sums(steps(between, m)), m, lambda s, w: F.struct(s.alias("start"), (s + F.char_length(w)).alias("end"), w.alias("match"))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def binomial_limit(n: Column, rate: float, log_level: Column) -> Column:
    """The largest k with P(Binomial(n, rate) <= k) <= exp(log_level), or -1: an exact lower tail, in logarithms.

    Terms up to n * rate are enough, as the tail passes one half there.
    """
    odds = math.log(rate / (1 - rate))
    nd = n.cast("double")
    start = F.struct(F.lit(-1).cast("long").alias("k"), (nd * math.log1p(-rate)).alias("term"), F.lit(-1e308).alias("tail"))

    def step(s: Column, i: Column) -> Column:
        high = F.greatest(s["tail"], s["term"])
        tail = high + F.log(F.exp(s["tail"] - high) + F.exp(s["term"] - high))
        term = s["term"] + F.log((nd - i) / (i + 1.0)) + F.lit(odds)
        return F.struct(F.when(tail <= log_level, i).otherwise(s["k"]).alias("k"), term.alias("term"), tail.alias("tail"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(nd * rate).cast("long")), start, step, lambda s: s["k"])
