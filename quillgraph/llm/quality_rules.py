"""Quality rules with risk-controlled cutoffs, in built-in functions only.

Five shares of a text are measured in thousandths: symbols, repeated lines, repeated words, capitals, length of words.
For each language (null is a language of its own) and rule the cutoff is the lowest one whose false rejections among
labelled good texts are few enough that an exact binomial bound holds the rate below ``risk / rules``, at a level split over
all languages and rules (Bonferroni); within a rule cutoffs are tried from the highest down, a fixed sequence that needs no
further split. A language with too few labels for any cutoff has no rule, and its texts are kept.

Null texts have no words. Repeated ids count as rows; a label given several times counts as good only if all say so; null
labels and null ids of labels say nothing. A share exactly at a cutoff is kept; of several cutoffs that hold the risk the lowest counts. Very
long texts are measured whole, in memory of the order of the text. Empty tables give empty results. Extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import binomial_limit, let, words_of
from .runtime import stored

#: Share of good texts that the method may reject in a language, and the chance that it rejects more in any.
RISK, LEVEL = 0.02, 0.05
#: Base limits: fewest words, and the percentage of words in repeated windows; words of a window.
FEWEST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Numerator and denominator of each rule, over the measures below; at most 1000 thousandths.
RULES = {
    "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"), "long_words": ("word_chars", "20 * n_words"),
}


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; windows start one word apart.

    Sorted by hash, equal neighbours are repeats; their places, sorted, cover up to ``WINDOW`` words each.
    """
    T = "array<struct<h:bigint,i:int>>"
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        after = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(y["h"] == x["h"], F.lit(False)).alias("same")))
        before = F.concat(F.array(F.lit(None)).cast(T), F.slice(s, 1, F.size(s) - 1))
        both = F.zip_with(after, before, lambda x, y: F.struct(x["i"].alias("i"), (x["same"] | F.coalesce(y["h"] == x["h"], F.lit(False))).alias("same")))
        return F.sort_array(F.transform(F.filter(both, lambda x: x["same"]), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)

    repeated = let(by_hash, lambda s: let(places(s), covered))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), repeated).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document with its counts; nothing is exploded or shuffled."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    only = lambda cls: F.char_length(F.regexp_replace("text", f"[^{cls}]+", "")).cast("long")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = src.select("doc_id", "lang", words_of(F.col("text")).alias("w"), lines.alias("l"), only("#*$%&|<>").alias("n_symbols"), only("A-Z").alias("n_capitals"))
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    two = let(hashed, lambda h: F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b)))
    four = let(two, lambda h: F.zip_with(h, F.slice(h, 3, F.size(h)), lambda a, b: F.xxhash64(a, b)))
    eight = let(four, lambda h: F.slice(F.zip_with(h, F.slice(h, 5, F.size(h)), lambda a, b: F.xxhash64(a, b)), 1, F.size(h) - (WINDOW - 1)))
    windows = F.when(F.size("w") > WINDOW, eight).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id", "lang", "n_symbols", "n_capitals", F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), let(windows, _repeat_words).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def shares(rows: DataFrame) -> DataFrame:
    """Adds each rule's share in thousandths, rounded up, 1000 at most."""
    share = {k: F.expr(f"int(least(1000, if({d} = 0, 0, (1000 * {n} + {d} - 1) div ({d}))))") for k, (n, d) in RULES.items()}
    return rows.withColumns({f"share_{k}": c for k, c in share.items()})


def cutoffs(measured: DataFrame, labels: DataFrame, *, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``lang, rule, cutoff, n_good, false_rejections``: what may be rejected above which share. Sizes: languages x rules x 1001."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    rated = shares(measured).join(good, "doc_id", "left_semi")
    long = rated.select(F.coalesce("lang", F.lit("")).alias("lang"), F.expr("stack(%d, %s) as (rule, share)" % (len(RULES), ", ".join(f"'{k}', share_{k}" for k in RULES))))
    seen = long.groupBy("lang", "rule", "share").agg(F.count("*").alias("n"))
    full = seen.groupBy("lang", "rule").agg(F.sum("n").alias("n_good"), F.sort_array(F.collect_list(F.struct("share", "n"))).alias("found"))
    tests = max(1, full.count())
    limit = full.withColumn("k", binomial_limit(F.col("n_good"), risk / len(RULES), F.lit(math.log(level / tests))))
    above = lambda c: F.aggregate(F.filter("found", lambda x: x["share"] > c), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    tried = F.filter(F.concat(F.array(F.lit(0)), F.transform("found", lambda x: x["share"])), lambda c: above(c) <= F.col("k"))
    return limit.filter("k >= 0").select("lang", "rule", F.array_min(tried).alias("cutoff"), "n_good", above(F.array_min(tried)).alias("false_rejections"))


def judge(docs: DataFrame, labels: DataFrame, *, risk: float = RISK, level: float = LEVEL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document its counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    measured = stored(measures(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), "measures")
    cuts = cutoffs(measured, labels.select("doc_id", "quality"), risk=risk, level=level)
    by_lang = cuts.groupBy(F.col("lang").alias("_lang")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    rows = shares(measured).withColumn("_lang", F.coalesce("lang", F.lit(""))).join(by_lang, "_lang", "left")
    broken = F.array_compact(F.array(*[F.when(F.col(f"share_{k}") > F.col("cuts")[k], F.lit(k)) for k in RULES]))
    done = rows.withColumn("failed_rules", broken)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"))


#: The same in DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        least(1000, CASE WHEN word_chars = 0 THEN 0 ELSE (1000 * n_symbols + word_chars - 1) // word_chars END) AS symbols,
        least(1000, CASE WHEN n_lines = 0 THEN 0 ELSE (1000 * n_dup_lines + n_lines - 1) // n_lines END) AS dup_lines,
        least(1000, CASE WHEN n_words = 0 THEN 0 ELSE (1000 * n_repeat_words + n_words - 1) // n_words END) AS repeats,
        least(1000, CASE WHEN word_chars = 0 THEN 0 ELSE (1000 * n_capitals + word_chars - 1) // word_chars END) AS capitals,
        least(1000, CASE WHEN n_words = 0 THEN 0 ELSE (1000 * word_chars + 20 * n_words - 1) // (20 * n_words) END) AS long_words FROM m),
u AS (UNPIVOT s ON symbols, dup_lines, repeats, capitals, long_words INTO NAME rule VALUE share),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
g AS (SELECT lang, rule, share FROM u WHERE doc_id IN (SELECT doc_id FROM good)),
n AS (SELECT lang, count(*) // 5 AS n FROM g GROUP BY lang),
lv AS (SELECT ln(0.05 / (count(*) * 5)) AS lev FROM n),
tail AS (SELECT lang, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.004) + (n - i) * ln(0.996))) OVER (PARTITION BY lang ORDER BY i) AS p
    FROM (SELECT lang, n, unnest(range(0, CAST(floor(n * 0.004) AS BIGINT) + 1)) AS i FROM n)),
lim AS (SELECT lang, max(i) AS k FROM tail, lv WHERE ln(p) <= lev GROUP BY lang),
c AS (SELECT DISTINCT lang, rule, share AS cut FROM g UNION SELECT DISTINCT lang, rule, 0 FROM g),
cut AS (SELECT c.lang, c.rule, min(c.cut) AS cutoff FROM c JOIN lim USING (lang)
    WHERE (SELECT count(*) FROM g WHERE g.lang = c.lang AND g.rule = c.rule AND g.share > c.cut) <= lim.k GROUP BY ALL),
bad AS (SELECT u.rid, string_agg(u.rule, ',' ORDER BY CASE u.rule WHEN 'symbols' THEN 1 WHEN 'dup_lines' THEN 2 WHEN 'repeats' THEN 3 WHEN 'capitals' THEN 4 ELSE 5 END) AS rules
    FROM u JOIN cut USING (lang, rule) WHERE u.share > cut.cutoff GROUP BY u.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.rid IS NULL AS kept, coalesce(bad.rules, '') AS failed_rules FROM s LEFT JOIN bad USING (rid)
"""
