"""Secret scan over whole texts, in built-in functions only.

Base spans come from three patterns. The method adds spans by a battery of randomness tests: every run of 20 or more
characters of ``A-Za-z0-9+/_=-`` is a candidate; of a run that base spans touch, what they leave, read as one string, if it has 20
characters or more. It gets an inferred encoding (16, 26, 32 or 64 signs; letters in one case or capitalised have 26), and over it three
scores: chi-squared uniformity of the alphabet (as a normal score, only its excess counts), runs above and below the middle,
and serial correlation of neighbours. The sum of squares is small for random strings. How small an ordinary string of that
length gets is a fixed reference, whatever the corpus: runs of words joined as names are, whose log scores have the mean and
spread of REFERENCE at the shortest length of each band; longer ordinary runs look less random, so the bound is on the safe side.
A string's p-value is the normal tail below its log score, with the spread widened by WIDER as that tail is heavier. False
discoveries are held by the Benjamini-Hochberg rule within each encoding and band of lengths.

Places are code points, end exclusive. Null and empty texts have no spans. Very long texts and runs are whole, in memory of the order
of the text. A score at the cutoff counts as random; overlapping spans of different kinds are all reported, and masked as one.
Repeated rows give repeated results. A null id stays null. Empty tables give empty results. Extra columns, whatever their names, are not read; ``redacted`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import let, match_spans
from .runtime import stored

#: Base kinds in their order; matches of ASSIGN with a value below 6 characters are dropped.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # leftmost runs of AKIA[A-Z0-9]+ with 20 characters or more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the battery and its false discovery rate; normal scores are kept in hundredths from a lowest one to 0.
RUN, RATE, LOWEST = r"[A-Za-z0-9+/_=-]{20,}", 0.01, -800
ALPHABETS = {16: "0123456789abcdef", 26: "abcdefghijklmnopqrstuvwxyz", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Mean and spread of the log score of ordinary strings by signs and band (tests/llm/test_native.py makes them anew), and a factor on the spread.
REFERENCE = {
    16: ((1.522, 0.688), (1.68, 0.691), (1.911, 0.66), (2.095, 0.648), (2.335, 0.615), (2.563, 0.554), (2.821, 0.506), (3.063, 0.445), (3.286, 0.403), (3.532, 0.356), (3.761, 0.307), (3.967, 0.275), (4.17, 0.251)),
    26: ((1.566, 0.689), (1.743, 0.687), (1.976, 0.658), (2.204, 0.627), (2.438, 0.596), (2.728, 0.541), (2.989, 0.471), (3.251, 0.416), (3.478, 0.365), (3.749, 0.317), (3.979, 0.281), (4.211, 0.253), (4.424, 0.227)),
    32: ((1.812, 0.69), (2.069, 0.675), (2.345, 0.632), (2.599, 0.588), (2.836, 0.534), (3.136, 0.468), (3.391, 0.424), (3.665, 0.372), (3.898, 0.342), (4.147, 0.297), (4.376, 0.264), (4.601, 0.235), (4.819, 0.215)),
    64: ((2.588, 0.739), (2.907, 0.711), (3.237, 0.654), (3.531, 0.616), (3.781, 0.586), (4.086, 0.534), (4.356, 0.491), (4.6, 0.46), (4.847, 0.426), (5.082, 0.405), (5.315, 0.379), (5.525, 0.355), (5.741, 0.332)),
}
WIDER = 1.25
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _assigned(text: Column) -> Column:
    """Matches of ASSIGN whose second group has 6 characters or more; the value is the end of the match."""
    long = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    return F.filter(match_spans(text, ASSIGN), lambda s: long(s["match"]))


def score(values: Column, signs: int) -> Column:
    """The battery over numbers 0..signs-1: small means random."""

    def run(v: Column) -> Column:
        n = F.size(v).cast("double")
        zero = F.struct(F.lit(-1).alias("prev"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sq"))
        counted = F.aggregate(
            F.sort_array(v), zero,
            lambda s, x: F.struct(x.alias("prev"), F.when(s["prev"] == x, s["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"), F.when(s["prev"] == x, s["sq"] + 2.0 * s["run"] + 1.0).otherwise(s["sq"] + 1.0).alias("sq")),
            lambda s: s["sq"],
        )
        df = signs - 1.0
        spread = 2.0 / (9.0 * df)
        # Wilson-Hilferty: the cube root of a chi-squared variable over its degrees of freedom is nearly normal
        chi = (F.pow(F.greatest(counted * float(signs) / n - n, F.lit(0.0)) / df, F.lit(1.0 / 3.0)) - (1.0 - spread)) / spread**0.5
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
        high = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(x >= signs // 2, 1.0).otherwise(0.0))
        turns = F.aggregate(F.zip_with(F.slice(v, 2, F.size(v)), F.slice(v, 1, F.size(v) - 1), lambda a, b: F.when((a >= signs // 2) != (b >= signs // 2), 1.0).otherwise(0.0)), F.lit(1.0), lambda s, x: s + x)
        pq = 2.0 * high * (n - high)
        runs_sd = F.sqrt(F.greatest(pq * (pq - n) / (n * n * (n - 1.0)), F.lit(1e-9)))
        runs = F.when((high == 0) | (high == n), F.lit(9.0)).otherwise((turns - (pq / n + 1.0)) / F.greatest(runs_sd, F.lit(0.3)))
        dev = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
        lag = F.aggregate(F.zip_with(F.slice(v, 2, F.size(v)), F.slice(v, 1, F.size(v) - 1), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda s, x: s + x)
        serial = F.when(dev == 0, F.lit(9.0)).otherwise(lag / dev * F.sqrt(n))
        return F.pow(F.greatest(chi, F.lit(0.0)), F.lit(2.0)) + runs * runs + serial * serial

    return let(values, run)


def _chars(token: Column) -> Column:
    return F.filter(F.split(token, "", -1), lambda c: c != "")


def _signs(token: Column) -> Column:
    """Signs of the inferred encoding."""
    return F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)=*$"), 16).when(token.rlike("^([A-Za-z][a-z]+|[A-Z]+)=*$"), 26).when(token.rlike("^[A-Z2-7]+=*$"), 32).otherwise(64)


def _band(token: Column) -> Column:
    """Band of lengths: a new one for each quarter of a power of two, the last open."""
    return F.least(F.floor(F.log2(F.char_length(token) / 20.0) * 4.0), F.lit(12)).cast("int")


def _read(token: Column, signs: int) -> Column:
    """The signs of a token as numbers; padding is left out, ``-`` and ``_`` read as ``+`` and ``/``."""
    plain = F.translate(F.lower(token) if signs in (16, 26) else token, "-_=", "+/")
    return F.transform(_chars(plain), lambda c: F.greatest(F.instr(F.lit(ALPHABETS[signs]), c) - 1, F.lit(0)))


def _normal(token: Column, signs: int) -> Column:
    """The score of a token as a normal score among ordinary strings, in hundredths and rounded up."""
    mean, spread = (F.element_at(F.array(*[F.lit(x[i]) for x in REFERENCE[signs]]), _band(token) + 1) for i in (0, 1))
    z = F.ceil((F.log1p(score(_read(token, signs), signs)) - mean) / (spread * WIDER) * 100.0)
    return F.greatest(F.least(z, F.lit(0)), F.lit(LOWEST)).cast("int")


def _left(run: Column, base: Column) -> Column:
    """A run as ``parts`` outside base spans and the ``match`` that they are together."""
    none = F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("parts"))
    part = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    step = lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), F.when(b["start"] > s["at"], F.concat(s["parts"], part(s["at"], b["start"]))).otherwise(s["parts"]).alias("parts"))
    last = lambda s: F.when(s["at"] < run["end"], F.concat(s["parts"], part(s["at"], run["end"]))).otherwise(s["parts"])
    touched = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    text = lambda parts: F.array_join(F.transform(parts, lambda x: F.substring(run["match"], (x["start"] - run["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))), "")
    whole = F.struct(part(run["start"], run["end"]).alias("parts"), run["match"].alias("match"))
    cut = let(F.aggregate(touched, none, step, last), lambda parts: F.struct(parts.alias("parts"), text(parts).alias("match")))
    return F.when(F.size(touched) == 0, whole).otherwise(cut)


def found(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its base spans and the candidates of the battery with their scores; nothing is shuffled."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return _scored(src, "doc_id")


def _scored(src: DataFrame, *more: str) -> DataFrame:
    """``base`` and ``candidates`` of a column ``text`` without nulls, besides other columns."""
    text = F.col("text")
    base = F.array_sort(F.concat(_kind(_assigned(text), 0), _kind(match_spans(text, ACCESS), 1), _kind(match_spans(text, HEX), 2)))
    spans = src.select(*more, base.alias("base"), match_spans(text, RUN).alias("runs"))
    free = F.filter(F.transform("runs", lambda r: _left(r, F.col("base"))), lambda r: F.char_length(r["match"]) >= 20)
    split = spans.select(*more, "base", free.alias("runs"))
    signed = F.transform("runs", lambda r: F.struct(r["parts"].alias("parts"), _signs(r["match"]).alias("signs"), _band(r["match"]).alias("band"), F.coalesce(*[F.when(_signs(r["match"]) == k, _normal(r["match"], k)) for k in ALPHABETS]).alias("score")))
    return split.select(*more, "base", signed.alias("candidates"))


def cutoffs(scored: DataFrame, *, rate: float = RATE) -> DataFrame:
    """``signs, band, score``: the highest score that counts as random. Counts by score are bounded, whatever the corpus."""
    tally = scored.select(F.explode("candidates").alias("x")).groupBy("x.signs", "x.band", "x.score").agg(F.count("*").alias("n"))
    below = ", ".join(f"{math.erfc(-z / 100 / math.sqrt(2)) / 2!r}D" for z in range(LOWEST, 1))
    whole = W.partitionBy("signs", "band")
    upto = whole.orderBy("score").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = tally.select("signs", "band", "score", F.expr(f"element_at(array({below}), score - {LOWEST} + 1)").alias("p"), F.sum("n").over(upto).alias("at"), F.sum("n").over(whole).alias("total"))
    return ranked.filter(F.col("p") <= F.lit(rate) * F.col("at") / F.col("total")).groupBy("signs", "band").agg(F.max("score").alias("score"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def _hit(scored: DataFrame, rate: float):
    """Whether a candidate counts as random."""
    limits = {(r["signs"], r["band"]): r["score"] for r in cutoffs(scored, rate=rate).collect()}  # 4 encodings x 13 bands at most
    return lambda c: F.coalesce(*[F.when((c["signs"] == k) & (c["band"] == b), c["score"] <= s) for (k, b), s in limits.items()], F.lit(False))


def _parts(hits: Column) -> Column:
    return F.flatten(F.transform(hits, lambda c: c["parts"]))


def scan(docs: DataFrame, *, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``random`` spans as arrays of (start, kind, end)."""
    scored = stored(found(docs, id_col=id_col, text_col=text_col), "secrets")
    return scored.select("doc_id", "base", _kind(_parts(F.filter("candidates", _hit(scored, rate))), 3).alias("random"))


def redacted(docs: DataFrame, *, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All documents with their columns; spans, joined where they overlap, give way to ``mark``, and ``size_col`` is the new length.
    Nothing is shuffled: the spans are found once for the cutoffs and once more on the way."""
    hit = _hit(stored(found(docs, id_col=id_col, text_col=text_col), "secrets"), rate)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    where = docs.columns.index(text_col)
    src = docs.toDF(*names).withColumn("text", F.coalesce(F.col(names[where]), F.lit("")))
    both = _scored(src, *names, "text")
    spans = F.array_sort(F.concat("base", _kind(_parts(F.filter("candidates", hit)), 3)))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def joined(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (s["start"] < F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(pair(last["start"], F.greatest(last["end"], s["end"]))))).otherwise(F.concat(acc, F.array(pair(s["start"], s["end"]))))

    def masked(m: Column) -> Column:
        begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(m, lambda s: s["end"]))
        ends = F.concat(F.transform(m, lambda s: s["start"]), F.array(F.char_length("text").cast("long")))
        return F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))), mark)

    new = F.when(F.size("spans") > 0, let(F.aggregate("spans", none, joined), masked)).otherwise(F.col(names[where]))
    out = both.withColumn("spans", spans).withColumn("_new", new)
    cols = [F.col("_new") if i == where else F.when(F.size("spans") > 0, F.char_length("_new").cast(docs.schema[c].dataType)).otherwise(F.col(names[i])) if c == size_col else F.col(names[i]) for i, c in enumerate(docs.columns)]
    return out.select(*[x.alias(c) for x, c in zip(cols, docs.columns, strict=True)])


def report(docs: DataFrame, *, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, rate=rate, id_col=id_col, text_col=text_col).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
