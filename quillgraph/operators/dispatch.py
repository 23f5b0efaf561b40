"""Calls through interfaces: which implementation is meant, and which class up the chain declares the method."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import bfs
from .resolve import suffixes

#: How a rule's choice is called, by its number.
HOW = {1: "QUALIFIED", 2: "QUALIFIED", 3: "QUALIFIED", 4: "HEURISTIC", 5: "QUALIFIED", 6: "PRIMARY"}


def _pieces(text: Column, longest: Column) -> Column:
    """Every substring of up to ``longest`` characters, once, the empty one included: makes containment an equality."""
    size = F.char_length(text)
    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    lengths = lambda i: F.sequence(F.lit(0), F.least(longest, size - i + 1))
    return F.when(text.isNotNull(), F.array_union(F.array(F.lit("")), F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda n: F.substring(text, i, n))))))


def narrow(calls: DataFrame, impls: DataFrame, beans: DataFrame) -> DataFrame:
    """``k, impl, rule, how`` of ``calls(k, iface, field, qualifier)``: the implementation that the first fitting rule names, the first by
    ``ord`` if it names several; nulls if none does.

    Rules: the qualifier is the simple name with a small first letter, or the end of the full name; a bean of that name is the
    implementation; the simple name holds the qualifier, whatever the case; the field's name (above three characters) and the simple name hold one
    another; a bean of the field's name is it; it is the only primary one. Without a field only the last applies.
    ``impls(iface, impl, simple, primary, ord)``, ``beans(name, bean)`` with names once.

    Each rule is an equality: implementations have a row for every name that a rule would take, of which the asked ones are kept, and of those
    of a name the first. No call meets all implementations of its interface.
    """
    asked = calls.filter("iface is not null").select("iface", "field", F.when(F.col("field").isNotNull(), F.col("qualifier")).alias("qualifier")).distinct()
    by_qualifier = asked.filter("qualifier is not null").select("iface", F.col("qualifier").alias("name")).distinct()
    by_field = asked.filter("field is not null").select("iface", F.col("field").alias("name")).distinct()
    long_field = by_field.filter(F.char_length("name") > 3)
    first = F.min(F.struct("ord", "impl"))

    def named(names: DataFrame, keys: Column, rule: int, by: Callable[[Column], Column] = lambda name: name, of: DataFrame = impls) -> DataFrame:
        """The first implementation of each name whose form ``by`` is among ``keys``."""
        forms = names.withColumn("form", by(F.col("name")))
        held = of.select("iface", "impl", "ord", F.explode(F.array_distinct(keys)).alias("form")).join(forms, ["iface", "form"], "left_semi")
        return held.groupBy("iface", "form").agg(first.alias("f")).join(forms, ["iface", "form"]).select("iface", "name", "f", F.lit(rule).alias("rule"))

    def beaned(names: DataFrame, rule: int) -> DataFrame:
        found = names.join(beans, "name").join(impls.withColumnRenamed("impl", "bean"), ["iface", "bean"]).withColumnRenamed("bean", "impl")
        return found.groupBy("iface", "name").agg(first.alias("f")).select("iface", "name", "f", F.lit(rule).alias("rule"))

    def longest(names: DataFrame, name: str) -> DataFrame:
        return names.agg(F.coalesce(F.max(F.char_length(F.lower(name))), F.lit(0)).alias("longest"))

    tails = lambda name: F.slice(suffixes(name), 2, F.char_length(name) + 1)
    simple, none = F.lower("simple"), F.array().cast("array<string>")
    bean_name = F.concat(F.lower(F.substring("simple", 1, 1)), F.expr("substring(simple, 2)"))
    known = lambda keys: F.filter(F.coalesce(keys, none), lambda x: x.isNotNull())
    inside = known(_pieces(simple, F.col("longest")))
    names = impls.filter("simple is not null").groupBy("iface", simple.alias("form")).agg(first.alias("f"))
    holding = long_field.crossJoin(F.broadcast(longest(impls, "simple"))).select("iface", "name", F.explode(_pieces(F.lower("name"), F.col("longest"))).alias("form")).join(names, ["iface", "form"])
    ways = {
        "qualifier": [
            named(by_qualifier, F.concat(known(F.array(bean_name)), known(tails(F.col("impl")))), 1),
            beaned(by_qualifier, 2),
            named(by_qualifier, F.concat(inside, known(tails(F.lower("impl")))), 3, F.lower, impls.crossJoin(F.broadcast(longest(by_qualifier, "name")))),
        ],
        "field": [
            named(long_field, inside, 4, F.lower, impls.crossJoin(F.broadcast(longest(long_field, "name")))),
            holding.select("iface", "name", "f", F.lit(4).alias("rule")),
            beaned(by_field, 5),
        ],
    }
    best = lambda df, *keys: df.groupBy(*keys).agg(F.min(F.struct("rule", "f.ord", "f.impl")).alias("best"))
    sole = impls.groupBy("iface").agg(F.count_if("primary").alias("n"), F.min(F.when(F.col("primary"), F.struct("ord", "impl"))).alias("f")).filter("n = 1")
    found = asked
    for column, rules in ways.items():
        found = found.join(best(reduce(DataFrame.unionByName, rules), "iface", "name").select("iface", F.col("name").alias(column), F.col("best").alias(f"by_{column}")), ["iface", column], "left")
    found = found.join(sole.select("iface", F.struct(F.lit(6).alias("rule"), "f.ord", "f.impl").alias("by_primary")), "iface", "left")
    found = found.select(*(F.col(c).alias(f"_{c}") for c in ("iface", "field", "qualifier")), F.least("by_qualifier", "by_field", "by_primary").alias("best")).filter("best is not null")
    same = [F.col("iface") == F.col("_iface"), F.col("field").eqNullSafe(F.col("_field")), F.when(F.col("field").isNotNull(), F.col("qualifier")).eqNullSafe(F.col("_qualifier"))]
    chosen = calls.join(found, same).groupBy("k").agg(F.min("best").alias("best")).select("k", "best.impl", "best.rule")
    how = F.create_map(*[F.lit(x) for kv in HOW.items() for x in kv])
    return calls.select("k").join(chosen, "k", "left").withColumn("how", how[F.col("rule")])


def declared_by(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """``cls, method, owner, up`` of ``calls(cls, method)``: the nearest class from ``cls`` up ``classes(src, dst)`` (class, superclass) that
    declares the method, and how far up; nulls if none does. ``methods(owner, method)``."""
    asked = calls.select("cls", "method").distinct()
    above = bfs(classes, asked.select(F.col("cls").alias("root")).distinct()).select(F.col("root").alias("cls"), F.col("node").alias("owner"), F.col("depth").alias("up"))
    found = asked.join(above, "cls").join(methods.select("owner", "method").distinct(), ["owner", "method"])
    return asked.join(found.groupBy("cls", "method").agg(F.min_by("owner", F.struct("up", "owner")).alias("owner"), F.min("up").alias("up")), ["cls", "method"], "left")
