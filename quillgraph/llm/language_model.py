"""Interpolated modified Kneser-Ney bigram model of words, counted in Spark and stored as sorted arrays.

Counting: a first pass makes the vocabulary, sorted by word hash and cut into shards of the hash range; a word's id is its
place. A second pass counts pairs of ids in shards of the first id's range; the pairs of a very frequent first word are dealt
over several shards by the second. A shard holds its pairs as a sorted array with counts, and for each first word its total
and how many second words follow it once, twice, or more often; distinct first words per second word meet in the shard of
that second word. Only sums of fixed size and the very frequent words, of which there are at most as many as shards,
come to the driver.

Scoring: workers map the shards and look up the distinct words and pairs of a block by binary search, in sorted order.

Tokens: words, A-Z lower-cased if ``fold``, then one end; a text's first token follows a start, which is no token. The lower
order is the continuation distribution, interpolated with the uniform one over the vocabulary and one unknown word; an unknown
first word leaves the lower order alone. With too few counts of counts for a discount, it is 0.75 * k below k = 3, else 2.25.

Null and empty texts are an end alone. Repeated rows count each time; words that are equally frequent need no order, as ids go by
hash. Very long texts are counted and scored whole, in memory of the order of the text. A null id is scored, and held out as the
empty id would be. No training text at all: every word is unknown and has the probability 1. Empty tables give empty results.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shard_store as store
from . import text_kernel as K
from .runtime import drop_table, fresh_dir, narrowed, partitions, pieces, prepare, stored

#: Bytes of text that a counting task takes together.
COUNT_BYTES = 16 << 20
#: Bytes of text that are scored together.
SCORE_BYTES = 4 << 20
#: Hash of the end token.
END = np.uint64(0x0123456789ABCDEF)
_32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
#: Most frequent words that a vocabulary shard reports.
REPORTED = 64


@dataclass(frozen=True)
class Model:
    """What a worker needs besides the mapped arrays; its size is bounded by the number of shards."""

    folder: str
    shards: int
    fold: bool
    bases: tuple[int, ...]  # first id of each vocabulary shard, then the vocabulary's size
    tokens: int
    texts: int
    spread: tuple[tuple[int, int], ...]  # very frequent first words: id, shards that their pairs are dealt over
    pair_discounts: tuple[float, ...] = ()
    word_discounts: tuple[float, ...] = ()
    pairs: int = 0
    word_rest: float = 0.0  # weight of the uniform distribution
    totals: tuple[tuple[int, tuple[int, ...]], ...] = ()  # of the very frequent first words: count, followed once, twice, more

    @property
    def vocabulary(self) -> int:
        return self.bases[-1]


def tokens(buf: np.ndarray, offs: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row with its end, and where rows start (with a last entry)."""
    if fold:
        buf = K.lower_ascii(buf)
    starts, ends, first = K.word_spans(buf, offs)
    rows = len(offs) - 1
    cuts = first + np.arange(rows + 1)
    out = np.empty(len(starts) + rows, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[cuts[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = K.span_hashes(buf, starts, ends)
    return out, cuts


def tally(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, with their counts (or sums of weights)."""
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, weights = values[order], weights[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.append(start, len(values))) if weights is None else (np.add.reduceat(weights, start) if len(start) else np.zeros(0, np.int64))
    return values[start], counts


class Tally:
    """Running ``tally`` of many parts in memory of the order of the distinct values."""

    def __init__(self, dtype):
        self.values, self.counts = [np.zeros(0, dtype)], [np.zeros(0, np.int64)]
        self.held = 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.values.append(values)
        self.counts.append(counts.astype(np.int64))
        self.held += len(values)
        if self.held > len(self.values[0]) + 2_000_000:
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        v, c = tally(np.concatenate(self.values), np.concatenate(self.counts))
        self.values, self.counts, self.held = [v], [c], 0
        return v, c


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of 32-bit numbers by place: high places are nearly constant and compress away."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def _unplanes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).ravel().view("<u4")


def slices(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and indices of its members, in order."""
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edge)).tolist():
        yield s, order[edge[s] : edge[s + 1]]


def payloads(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["shard", "payload"])


def hash_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _32) * np.uint64(shards) >> _32).astype(np.int64)


def _count_words(shards: int, fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", COUNT_BYTES):
            h, c = tally(tokens(*K.buffer_of(piece.column("text")), fold)[0])
            out = [(s, K.pack(h[i], K.put_varints(c[i])[0])) for s, i in slices(hash_shard(h, shards), shards)]
            if out:
                yield payloads(out)

    return run


def _merge_words(folder: str):
    """Writes the vocabulary shards; reports (shard, types, tokens, frequent words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Tally] = {}
        for b in batches:
            for s, x in zip(b.column("shard").to_pylist(), b.column("payload").to_pylist(), strict=True):
                h, c = K.unpack(x)
                sums.setdefault(s, Tally(np.uint64)).add(h.view(np.uint64), K.get_varints(c)[0])
        out = []
        for s, t in sums.items():
            h, c = t.done()
            store.put(folder, f"word-{s}", h)
            store.put(folder, f"word-count-{s}", c)
            top = np.argsort(-c, kind="stable")[:REPORTED]
            out.append((s, np.concatenate([[len(h), c.sum()], top, c[top]]).astype(np.int64).tobytes()))
        if out:
            yield payloads(out)

    return run


def word_ids(m: Model, h: np.ndarray, *more: str) -> tuple[np.ndarray, ...]:
    """Ids of sorted hashes (-1: unknown), and the named arrays' values at them (0: unknown)."""
    ids, found = np.full(len(h), -1, np.int64), [np.zeros(len(h), np.int64) for _ in more]
    edge = np.searchsorted(hash_shard(h, m.shards), np.arange(m.shards + 1))
    for s in np.flatnonzero(np.diff(edge)).tolist():
        if m.bases[s + 1] == m.bases[s]:
            continue
        a, b = edge[s], edge[s + 1]
        known = store.get(m.folder, f"word-{s}")
        at = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
        hit = known[at] == h[a:b]
        ids[a:b] = np.where(hit, m.bases[s] + at, -1)
        for x, name in zip(found, more, strict=True):
            x[a:b] = np.where(hit, store.get(m.folder, f"{name}-{s}")[at], 0)
    return ids, *found


def _pair_shard(m: Model, key: np.ndarray) -> np.ndarray:
    """Shard of a pair: by the first id's range; a very frequent first id's pairs are dealt over several by the second."""
    first = (key >> _32).astype(np.int64)
    shard = np.minimum(first * m.shards // (m.vocabulary + 1), m.shards - 1)
    for i, n in m.spread:
        mine = np.flatnonzero(first == i)
        if len(mine):
            second = K.mix((key[mine] & _LOW) + np.uint64(1))
            shard[mine] = (shard[mine] + ((second >> _32) * np.uint64(n) >> _32).astype(np.int64)) % m.shards
    return shard


def _pair_keys(m: Model, h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids of tokens and of what each follows: the start's id is the vocabulary's size."""
    distinct = tally(h)[0]
    ids = word_ids(m, distinct)[0][np.searchsorted(distinct, h)]
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[cuts[:-1]] = m.vocabulary
    return before, ids


def _count_pairs(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", COUNT_BYTES):
            before, ids = _pair_keys(m, *tokens(*K.buffer_of(piece.column("text")), m.fold))
            key, c = tally((before.astype(np.uint64) << _32) | ids.astype(np.uint64))
            out = []
            for s, i in slices(_pair_shard(m, key), m.shards):
                first, second = (key[i] >> _32).astype(np.int64), (key[i] & _LOW).astype(np.uint32)
                out.append((s, K.pack(K.put_varints(np.diff(first, prepend=0))[0], _planes(second), K.put_varints(c[i])[0])))
            if out:
                yield payloads(out)

    return run


def _of_counts(c: np.ndarray) -> np.ndarray:
    return np.array([(c == k).sum() for k in (1, 2, 3, 4)], np.int64)


def _merge_pairs(m: Model):
    """Writes the pair shards. Rows: (-1, sums), and (word shard, seconds with how many distinct firsts they have here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Tally] = {}
        for b in batches:
            for s, x in zip(b.column("shard").to_pylist(), b.column("payload").to_pylist(), strict=True):
                first, second, c = K.unpack(x)
                key = (np.cumsum(K.get_varints(first)[0]).astype(np.uint64) << _32) | _unplanes(second).astype(np.uint64)
                sums.setdefault(s, Tally(np.uint64)).add(key, K.get_varints(c)[0])
        frequent = np.array([i for i, _ in m.spread], np.int64)
        for s, t in sums.items():
            key, c = t.done()
            del t
            first = (key >> _32).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            stats = np.stack([np.add.reduceat(x.astype(np.int64), start) for x in (c, c == 1, c == 2, c > 2)])
            names = first[start]
            store.put(m.folder, f"pair-{s}", key)
            store.put(m.folder, f"pair-count-{s}", np.minimum(c, 2**32 - 1).astype(np.uint32))
            store.put(m.folder, f"first-{s}", names)
            for k, x in enumerate(stats):
                store.put(m.folder, f"first-{k}-{s}", x)
            mine = np.flatnonzero(np.isin(names, frequent))
            yield payloads([(-1, np.concatenate([[len(key)], _of_counts(c), np.concatenate([names[mine][None], stats[:, mine]]).T.ravel()]).astype(np.int64).tobytes())])
            second, n = tally(key & _LOW)
            bases = np.array(m.bases)
            where = np.searchsorted(bases, second.astype(np.int64), side="right") - 1
            yield payloads([(w, K.pack(K.put_varints(np.diff(second[i].astype(np.int64) - bases[w], prepend=0))[0], K.put_varints(n[i])[0])) for w, i in slices(where, m.shards)])

    return run


def _merge_continuations(m: Model):
    """Writes how many distinct firsts each word of a vocabulary shard has; reports sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column("shard").to_pylist(), b.column("payload").to_pylist(), strict=True):
                at, n = K.unpack(x)
                if s not in sums:
                    sums[s] = np.zeros(m.bases[s + 1] - m.bases[s], np.int64)
                sums[s][np.cumsum(K.get_varints(at)[0])] += K.get_varints(n)[0]
        for s, c in sums.items():
            store.put(m.folder, f"word-firsts-{s}", c)
            yield payloads([(s, np.concatenate([_of_counts(c), [(c > 2).sum()]]).astype(np.int64).tobytes())])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, ...]:
    """Discounts of counts 0, 1, 2 and 3 or more from counts of counts."""
    if not (n1 and n2 and n3):
        return 0.0, 0.75, 1.5, 2.25
    y = n1 / (n1 + 2 * n2)
    return 0.0, *(min(max(d, 0.0), float(k)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


SCHEMA = "shard int, payload binary"


def train(texts: DataFrame, *, fold: bool = True, text_col: str = "text", label: str = "lm") -> Model:
    """The model of all rows of ``texts``, its arrays in a new folder of the shared store."""
    spark = prepare(texts.sparkSession)
    n, folder = partitions(spark), fresh_dir(spark, label)
    src = texts.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    numbers = lambda r: np.frombuffer(bytes(r["payload"]), np.int64)
    words = src.mapInArrow(_count_words(n, fold), SCHEMA).repartitionById(n, "shard").mapInArrow(_merge_words(folder), SCHEMA).collect()  # a row for each shard
    size, total, top = np.zeros(n, np.int64), 0, []
    for r in words:
        x = numbers(r)
        size[r["shard"]], total = x[0], total + int(x[1])
        k = (len(x) - 2) // 2
        top += [(r["shard"], int(i), int(c)) for i, c in zip(x[2 : 2 + k], x[2 + k :], strict=True)]
    bases = np.concatenate([[0], np.cumsum(size)])
    vocabulary = int(bases[-1])
    if vocabulary >= 2**32 - 1:
        raise ValueError("a word id has 32 bits")
    if not vocabulary:
        return Model(folder, n, fold, tuple(bases.tolist()), 0, 0, ())
    texts_n = texts.count()
    share = max(1, total // n)
    spread = [(int(bases[s]) + i, min(n, -(-2 * c // share))) for s, i, c in top if c > share] + ([(vocabulary, min(n, -(-2 * texts_n // share)))] if texts_n > share else [])
    m = Model(folder, n, fold, tuple(bases.tolist()), total, texts_n, tuple(sorted(spread)))
    merged = src.mapInArrow(_count_pairs(m), SCHEMA).repartitionById(n, "shard").mapInArrow(_merge_pairs(m), SCHEMA)
    merged = stored(merged, f"{label}-continuations")
    pairs, of_counts, totals = 0, np.zeros(4, np.int64), {}
    for r in merged.filter("shard < 0").collect():
        x = numbers(r)
        pairs, of_counts = pairs + int(x[0]), of_counts + x[1:5]
        for name, *stats in x[5:].reshape(-1, 5).tolist():
            totals[name] = np.array(stats) + totals.get(name, 0)
    word_counts, more = np.zeros(4, np.int64), 0
    for r in merged.filter("shard >= 0").repartitionById(n, "shard").mapInArrow(_merge_continuations(m), SCHEMA).collect():
        x = numbers(r)
        word_counts, more = word_counts + x[:4], more + int(x[4])
    drop_table(merged)
    wd = discounts(*word_counts.tolist())
    rest = (wd[1] * word_counts[0] + wd[2] * word_counts[1] + wd[3] * more) / pairs
    return Model(folder, n, fold, m.bases, total, texts_n, m.spread, discounts(*of_counts.tolist()), wd, pairs, float(rest), tuple((k, tuple(int(i) for i in v)) for k, v in totals.items()))


def first_stats(m: Model, first: np.ndarray) -> np.ndarray:
    """Total and numbers followed once, twice and more often, of sorted ids of first words (-1: none)."""
    out = np.zeros((4, len(first)), np.int64)
    known = np.flatnonzero(first >= 0)
    for s, i in slices(np.minimum(first[known] * m.shards // (m.vocabulary + 1), m.shards - 1), m.shards):
        i = known[i]
        try:
            names = store.get(m.folder, f"first-{s}")
        except FileNotFoundError:
            continue
        at = np.minimum(np.searchsorted(names, first[i]), len(names) - 1)
        hit = names[at] == first[i]
        for k in range(4):
            out[k, i] = np.where(hit, store.get(m.folder, f"first-{k}-{s}")[at], 0)
    for name, stats in m.totals:
        out[:, first == name] = np.array(stats)[:, None]
    return out


def log_probabilities(m: Model, before: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """log10 P(token | what it follows); ``firsts``: distinct words that each token's word follows in training."""
    if not m.vocabulary:
        return np.zeros(len(ids))
    wd, pd = np.array(m.word_discounts), np.array(m.pair_discounts)
    low = (firsts - wd[np.minimum(firsts, 3)]) / m.pairs + m.word_rest / (m.vocabulary + 1)
    both = (before >= 0) & (ids >= 0)
    key = (np.where(both, before, 0).astype(np.uint64) << _32) | np.where(both, ids, 0).astype(np.uint64)
    distinct = tally(key)[0]
    count = np.zeros(len(distinct), np.int64)
    for s, i in slices(_pair_shard(m, distinct), m.shards):
        try:
            known = store.get(m.folder, f"pair-{s}")
        except FileNotFoundError:
            continue
        at = np.minimum(np.searchsorted(known, distinct[i]), len(known) - 1)
        count[i] = np.where(known[at] == distinct[i], store.get(m.folder, f"pair-count-{s}")[at], 0)
    c = np.where(both, count[np.searchsorted(distinct, key)], 0)
    first = tally(before)[0]
    total, one, two, more = first_stats(m, first)[:, np.searchsorted(first, before)]
    seen = total > 0
    total = np.maximum(total, 1)
    p = np.where(seen, (c - pd[np.minimum(c, 3)]) / total + (pd[1] * one + pd[2] * two + pd[3] * more) / total * low, low)
    return np.log10(p)


def score_piece(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, known tokens, base score and score of each text."""
    h, cuts = tokens(*K.buffer_of(texts), m.fold)
    distinct = tally(h)[0]
    ids, count, firsts = (x[np.searchsorted(distinct, h)] for x in word_ids(m, distinct, "word-count", "word-firsts"))
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[cuts[:-1]] = m.vocabulary
    base = np.log10((count + 1) / (m.tokens + m.vocabulary + 1))
    score = log_probabilities(m, before, ids, firsts)
    return np.diff(cuts), *(np.add.reduceat(x, cuts[:-1]) for x in ((count > 0).astype(np.int64), base, score))


def _scorer(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", SCORE_BYTES):
            found = score_piece(m, piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held"), *map(pa.array, found)], ["doc_id", "held", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, m: Model, *, id_col: str = "doc_id", text_col: str = "text", held: str | None = None) -> DataFrame:
    """``doc_id, held, n_tokens, n_known, base_score, score`` of whole texts; ``held``: a string column that goes along."""
    prepare(docs.sparkSession)
    src = narrowed(docs, id_col, text_col, *([held] if held else []))
    src = src.select("doc_id", "text", (F.col(f"`{held}`").cast("string") if held else F.lit("")).alias("held"))
    return src.mapInArrow(_scorer(m), "doc_id long, held string, n_tokens long, n_known long, base_score double, score double")


def held_out_scores(docs: DataFrame, *, folds: int = 7, out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts by the model of those whose id's CRC (null: of no text) leaves another remainder than ``out``."""
    src = narrowed(docs, id_col, text_col).withColumn("held", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == out).cast("string"))
    m = train(src.filter("held = 'false'"))
    rows = score(src, m, held="held")
    return rows.select("doc_id", (F.col("held") == "true").alias("held_out"), "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")
