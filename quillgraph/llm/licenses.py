"""Licence notices in texts by the Dice coefficient over word bigrams, in built-in functions only.

A unit is a line, a sentence of a line, or a paragraph. Normalised (A-Z lower-cased, anything but letters and digits a space),
its set of word bigrams is compared with each template's; a unit of one word has that word as its set. Dice of ``LIMIT``
hundredths or more is a match. With d for that, the sizes of two such sets are within a factor of (2 - d) / d of each other, which
rules out most templates without comparing. A match also shares d / (2 - d) of the template's bigrams at least, so a text with none
of the words that touch the remaining share cannot match and is passed over whole: both bounds lose nothing.

Null and empty texts match nothing. A very long text is split whole, in memory of the order of the text. A coefficient exactly at the limit
matches. Repeated rows give repeated results; units that occur twice in a text count twice. Ties between templates are all
reported. A null id stays null. Empty tables give empty results. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let

#: The least Dice coefficient of a match, in hundredths: bounds and matches are compared in whole numbers.
LIMIT = 80
# Common notices (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.", "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "This work is dedicated to the public domain."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def normal_words(text: str) -> list[str]:
    """The normalised words of a template."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigram_list(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words))


def table() -> list[tuple[str, list[str]]]:
    """Name and bigrams of each template."""
    return [(name, bigram_list(normal_words(t))) for name, texts in TEMPLATES.items() for t in texts]


def marks(limit: int = LIMIT) -> list[str]:
    """Words of which a text with any match has at least one: for each template the fewest, longest words first, that touch more
    than the share of its bigrams that a match may miss."""
    chosen: list[str] = []
    for _, bigrams in table():
        words = sorted({w for b in bigrams for w in b.split()}, key=lambda w: (w not in chosen, -len(w), w))
        touched: set[str] = set()
        for w in words:
            if len(touched) * (200 - limit) > (200 - 2 * limit) * len(bigrams):
                break
            touched |= {b for b in bigrams if w in b.split()}
            if w not in chosen:
                chosen.append(w)
    return [w for w in chosen if not any(v != w and v in w for v in chosen)]


def _units(text: Column) -> Column:
    """Lines, sentences of lines with several, and paragraphs of several lines."""
    some = lambda a: F.filter(a, lambda x: x.rlike("[A-Za-z0-9]"))
    lines = some(F.split(text, "\n", -1))
    sentences = F.flatten(F.transform(lines, lambda x: let(some(F.split(x, r"(?<=[.!?;:])[\x20\x09]+", -1)), lambda s: F.when(F.size(s) > 1, s).otherwise(F.array().cast("array<string>")))))
    paragraphs = F.filter(F.split(text, r"\n[\x20\x09]*\n", -1), lambda x: F.trim(x).contains("\n"))
    return F.concat(lines, sentences, paragraphs)


def _bigrams(unit: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " ")), " ", -1)
    return let(words, lambda w: F.when(F.size(w) > 1, F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(w))


def scan(docs: DataFrame, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, licences, n_matches, best_dice`` for every document: names in order, units that match, the highest coefficient."""
    templates = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("b")) for n, b in table()])
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    some = None
    for w in marks(limit):
        has = F.contains(F.col("low"), F.lit(w))
        some = has if some is None else some | has
    sized = lambda n, t: (n * (200 - limit) >= t["n"] * limit) & (n * limit <= t["n"] * (200 - limit))

    def matched(b: Column) -> Column:
        near = F.filter(templates, lambda t: sized(F.size(b), t))
        rated = F.transform(near, lambda t: F.struct(F.size(F.array_intersect(b, t["b"])).alias("both"), (F.size(b) + t["n"]).alias("sum"), t["name"].alias("name")))
        hits = F.filter(rated, lambda r: 200 * r["both"] >= limit * r["sum"])
        return F.transform(hits, lambda r: F.struct((2.0 * r["both"] / r["sum"]).alias("dice"), r["name"].alias("name")))

    per_unit = F.filter(F.transform(_units(F.col("text")), lambda u: let(_bigrams(u), matched)), lambda m: F.size(m) > 0)
    none = F.array().cast("array<array<struct<dice:double,name:string>>>")
    rows = src.withColumn("low", F.lower("text")).select("doc_id", F.when(some, per_unit).otherwise(none).alias("m"))
    flat = rows.select("doc_id", F.size("m").cast("long").alias("n_matches"), F.flatten("m").alias("f"))
    return flat.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("f", lambda r: r["name"]))), ",").alias("licences"), "n_matches", F.round(F.coalesce(F.array_max(F.transform("f", lambda r: r["dice"])), F.lit(0.0)), 6).alias("best_dice"))


def oracle_sql() -> str:
    """The same in DuckDB."""
    rows = ", ".join("('%s', [%s])" % (n, ", ".join(f"'{x}'" for x in b)) for n, b in table())
    return rf"""
WITH t(name, b) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9]'))) AS u FROM d),
s AS (SELECT rid, list_filter(string_split_regex(regexp_replace(u, '([.!?;:])[\x20\x09]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS us FROM l),
p AS (SELECT rid, unnest(string_split_regex(text, '\n[\x20\x09]*\n')) AS u FROM d),
un AS (SELECT rid, u FROM l UNION ALL SELECT rid, unnest(us) FROM s WHERE len(us) > 1 UNION ALL SELECT rid, u FROM p WHERE contains(trim(u), chr(10))),
w AS (SELECT row_number() OVER () AS uid, rid, string_split(trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM un),
b AS (SELECT uid, rid, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS b FROM w),
m AS (SELECT uid, rid, name, len(list_intersect(b.b, t.b)) AS x, len(b.b) + len(t.b) AS s FROM b, t),
g AS (SELECT rid, count(DISTINCT uid) AS n, max(2.0 * x / s) AS best, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM m WHERE 200 * x >= {LIMIT} * s GROUP BY rid)
SELECT doc_id, coalesce(names, '') AS licences, coalesce(n, 0) AS n_matches, round(coalesce(best, 0.0), 6) AS best_dice FROM d LEFT JOIN g USING (rid)
"""
