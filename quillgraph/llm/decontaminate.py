"""Documents that hold a benchmark item, up to a few changed words.

Words are lower-cased (A-Z) runs of letters and digits; the distance is the edit distance over words. An item of ``n`` words is
held by a document with a passage at distance ``k(n)`` at most: a fifth of its words, rounded down (so none below five words).

Every item-sized window that shares enough word triples with an item goes through the CGK embedding: a random walk over the
window that repeats words, after which edits are Hamming distance. Each of ``REPEATS`` walks is sampled at two steps; a
window whose samples equal the item's in any walk is a candidate, and the region around it is verified by the exact
distance of the item to its best passage. How many triples are enough follows from the distance (an edit breaks three triples at
most), so that this first step loses nothing; the walks reach ``RECALL`` at the design distortion. Items of up to ``SHORT`` words,
of which an edit may leave no triple, go an exact way: the parts of an item cut into k(n) + 1, of which one is left whole by
k(n) edits, are looked up, and the region around each is verified.

The items are looked up from a broadcast slice of about ``SLICE_WORDS`` words; a larger benchmark is searched slice by
slice, one of them in memory at a time, so that any size is searched in full. Lookups of a block of texts are expanded for a few items at a time, ``EXPANDED``
at once unless a single item has more, so that a text which repeats a common triple takes time and not memory.

Null texts and items, and texts without words, hold nothing and are held by nothing. A null document id is reported like any
other; items without an id are not searched. Repeated documents are judged each, repeated items count once for each id. Of several passages with the
same distance the first to end is named. Very long texts and items are whole. Empty tables give empty results, and an empty
benchmark leaves every document clean. Extra columns, whatever their names, are not read, and ``clean`` keeps them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_kernel as K
from .runtime import drop_table, narrowed, pieces, prepare, rows_kept, stored

#: Bytes of text searched at once; nothing is shuffled, so that small blocks cost nothing else.
BLOCK = 2 << 20
#: Share of an item's words that may differ, most words of an item that goes the exact way, words of a benchmark slice.
SHARE, SHORT, SLICE_WORDS = 0.2, 5, 1_000_000
#: Lookups that are expanded together.
EXPANDED = 4_000_000
#: Target recall of the walks where this share of the embedding differs, and steps sampled of each walk.
RECALL, DISTORTION, SAMPLES = 0.95, 0.6, 2
REPEATS = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DISTORTION) ** SAMPLES))
#: Steps of a walk for each word, and what stands after a window's end.
STRETCH, PAD = 3, np.uint64(0)


def allowed(n: int) -> int:
    """Edits for an item of ``n`` words; above ``SHORT`` words few enough that a passage shares a triple with it."""
    return int(n * SHARE)


def needed(n: int) -> int:
    """Triples that a passage within the allowed edits shares with the item at least."""
    return max(1, n - 2 - 3 * allowed(n))


def plain_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and where rows start (with a last entry)."""
    low = K.lower_ascii(buf)
    starts, ends, first = K.plain_word_spans(low, offs)
    return K.span_hashes(low, starts, ends), first


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words."""
    out = h
    for k in range(1, n):
        out = K.pair_hash(out[:-1], h[k:]) if len(out) > 1 else out[:0]
    return out


def triples(h: np.ndarray) -> np.ndarray:
    return grams(h, 3)


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """The walk over each window ``starts[i]`` up to ``sizes[i]`` words, cut at ``ends[i]``: a row of words by step, PAD after.

    At a step the word under the pointer is written, and a coin of the step and the word says whether the pointer moves on.
    """
    steps = STRETCH * int(sizes.max()) if len(sizes) else 0
    out = np.zeros((steps, len(starts)), np.uint64)
    padded = np.append(words, PAD)
    stop, at = np.minimum(starts + sizes, ends), starts.copy()
    for j in range(steps):
        w = padded[np.where(at < stop, at, len(words))]
        out[j] = w
        coin = K.mix(w ^ np.uint64((walk * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F + 1) & (2**64 - 1))) & np.uint64(1)
        at = at + ((at < stop) & (coin == 1))
    return out


def samples(sizes: np.ndarray, walk: int) -> np.ndarray:
    """The sampled steps of a walk for each size."""
    r = K.mix(sizes[:, None].astype(np.uint64) * np.uint64(1_000_003) + np.uint64(walk * SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)[None])
    return (r % (sizes[:, None].astype(np.uint64) * np.uint64(STRETCH))).astype(np.int64)


def bits(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sampled words of all walks: windows x walks x samples."""
    out = np.zeros((len(starts), REPEATS, SAMPLES), np.uint64)
    for walk in range(REPEATS):
        table = embed(words, starts, ends, sizes, walk)
        at = samples(sizes, walk)
        for k in range(SAMPLES):
            out[:, walk, k] = table[at[:, k], np.arange(len(starts))] if len(starts) else out[:, walk, k]
    return out


def best_passage(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to any passage, and where the first such passage ends. Bit-parallel over the item."""
    n, ones, last = len(item), (1 << len(item)) - 1, 1 << (len(item) - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | (1 << i)
    up, down, score, best, end = ones, 0, n, n, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & ones
        right, left = (down | ~(d | up)) & ones, up & d
        score += bool(right & last) - bool(left & last)
        right, left = (right << 1) & ones, (left << 1) & ones
        up, down = (left | ~(d | right)) & ones, right & d
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """A slice of the benchmark, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]]):
        buf, offs = K.buffer_of(pa.array([t for _, t in rows], pa.string()))
        words, first = plain_words(buf, offs)
        size = np.diff(first)
        self.short = Short([(rows[i][0], words[first[i] : first[i + 1]]) for i in np.flatnonzero((size > 0) & (size <= SHORT)).tolist()])
        keep = np.flatnonzero(size > SHORT).tolist()
        self.ids = [rows[i][0] for i in keep]
        self.words = [words[first[i] : first[i + 1]] for i in keep]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([allowed(n) for n in self.sizes.tolist()], np.int64)
        self.needed = np.array([needed(n) for n in self.sizes.tolist()], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        begin = np.cumsum(self.sizes) - self.sizes
        self.bits = bits(flat, begin, begin + self.sizes, self.sizes)
        pairs = [np.unique(triples(w)) for w in self.words]
        t = np.concatenate([np.zeros(0, np.uint64), *pairs])
        owner = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        order = np.argsort(t, kind="stable")
        self.triples, self.owners = t[order], owner[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.triples >> np.uint64(44)).astype(np.int64)] = True

    def lookups(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word places whose triple is in an item, with the item, ordered by item and place: some items at a time."""
        t = triples(words)
        at = np.flatnonzero(self.maybe[(t >> np.uint64(44)).astype(np.int64)])
        at = at[at + 3 <= first[np.searchsorted(first, at, side="right")]]
        at = at[self.triples[np.minimum(np.searchsorted(self.triples, t[at]), len(self.triples) - 1)] == t[at]]
        if not len(at):
            return
        found, uses = np.unique(t[at], return_counts=True)
        known = np.minimum(np.searchsorted(found, self.triples), len(found) - 1)
        each = np.bincount(self.owners, np.where(found[known] == self.triples, uses[known], 0), len(self.ids))
        batch = np.cumsum(each) // EXPANDED
        for k in np.unique(batch[each > 0]).tolist():
            mine = (batch == k)[self.owners]
            tri, owners = self.triples[mine], self.owners[mine]
            low, high = np.searchsorted(tri, t[at]), np.searchsorted(tri, t[at], side="right")
            n = high - low
            place = np.repeat(at, n)
            item = owners[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            order = np.lexsort((place, item))
            yield place[order], item[order]

    def windows(self, place: np.ndarray, item: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of item-sized windows with enough triples of their item, the items, and their rows."""
        row = np.searchsorted(first, place, side="right") - 1
        last = np.arange(len(place)) + self.needed[item] - 1
        ok = last < len(place)
        i, j = np.flatnonzero(ok), last[ok]
        ok = (item[j] == item[i]) & (row[j] == row[i]) & (place[j] - place[i] <= self.sizes[item[i]] - 3)
        i, j = i[ok], j[ok]
        low = np.maximum(place[j] + 3 - self.sizes[item[i]], first[row[i]])
        # starts from low to place[i]: also those after the window's first words were edited away
        n = place[i] - low + 1
        start = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.unique(np.stack([np.repeat(item[i], n), start]), axis=1)
        return key[1], key[0], np.searchsorted(first, key[1], side="right") - 1

    def search(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item id, distance, end) of the items that rows hold."""
        if not len(words):
            return
        yield from self.short.search(words, first)
        if not len(self.ids):
            return
        for place, item in self.lookups(words, first):
            start, item, row = self.windows(place, item, first)
            for k in range(0, len(start), 20_000):  # memory stays that of so many walks
                s, i, r = start[k : k + 20_000], item[k : k + 20_000], row[k : k + 20_000]
                equal = (bits(words, s, first[r + 1], self.sizes[i]) == self.bits[i]).all(axis=2).any(axis=1)
                s, i, r = s[equal], i[equal], r[equal]
                e = self.edits[i]
                for a, b, x, y in regions(r, i, np.maximum(s - e, first[r]), np.minimum(s + self.sizes[i] + e, first[r + 1])):
                    d, end = best_passage(self.words[b].tolist(), words[x:y].tolist())
                    if d <= self.edits[b]:
                        yield a, self.ids[b], d, int(x + end - first[a])


def regions(row: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row, item and bounds of the places around candidates, those that overlap as one."""
    order = np.lexsort((low, item, row))
    row, item, low, high = row[order], item[order], low[order], high[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
    start = np.flatnonzero(new).tolist()
    for a, b in zip(start, [*start[1:], len(row)], strict=True) if start else ():
        yield int(row[a]), int(item[a]), int(low[a]), int(high[b - 1])


class Short:
    """Items of a few words: an item cut into one part more than it may have edits keeps one of them whole."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.words):
            cuts = [len(w) * j // (allowed(len(w)) + 1) for j in range(allowed(len(w)) + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                parts.setdefault(b - a, []).append((int(grams(w[a:b], b - a)[0]), k, a))
        self.parts = {}
        for n, rows in parts.items():
            rows.sort()
            self.parts[n] = np.array([h for h, _, _ in rows], np.uint64), np.array([k for _, k, _ in rows]), np.array([a for _, _, a in rows])

    def search(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        for n, (known, owner, shift) in self.parts.items():
            g = grams(words, n)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g)
            at = at[at + n <= first[np.searchsorted(first, at, side="right")]]
            for k in range(0, len(at), 100_000):
                p = at[k : k + 100_000]
                low, high = np.searchsorted(known, g[p]), np.searchsorted(known, g[p], side="right")
                place, entry = np.repeat(p, high - low), np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True))])
                item, size = owner[entry], np.array([len(w) for w in self.words])
                row, edits, begin = np.searchsorted(first, place, side="right") - 1, (size[item] * SHARE).astype(np.int64), place - shift[entry]
                for r, i, x, y in regions(row, item, np.maximum(begin - edits, first[row]), np.minimum(begin + size[item] + edits, first[row + 1])):
                    d, end = best_passage(self.words[i].tolist(), words[x:y].tolist())
                    if d <= allowed(len(self.words[i])):
                        yield r, self.ids[i], d, int(x + end - first[r])


def _marker(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = held.value
        for piece in pieces(batches, "text", BLOCK):
            words, first = plain_words(*K.buffer_of(piece.column("text")))
            found: list[dict[int, tuple[int, int]]] = [{} for _ in range(piece.num_rows)]
            for row, name, d, end in items.search(words, first):
                found[row][name] = min(found[row].get(name, (d, end)), (d, end))
            spans = [[{"item_id": k, "distance": d, "end_word": e} for k, (d, e) in sorted(f.items())] for f in found]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end_word", pa.int64())]))
            cols = [piece.column(c) for c in piece.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first)), pa.array(spans, kind)], [*(c for c in piece.schema.names if c != "text"), "n_words", "found"])

    return run


def item_slices(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark in slices of about ``SLICE_WORDS`` words, each checked before it comes to the driver."""
    rows = narrowed(benchmark, id_col, text_col).filter("doc_id is not null and text is not null").withColumn("n", F.octet_length("text"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = max(1, -(-total // (SLICE_WORDS * 6)))
    for k in range(slices):
        part = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == k)
        yield [(r["doc_id"], r["text"]) for r in part.select("doc_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, found`` for every document; ``found``: the items it holds, with distance and the passage's last word."""
    spark = prepare(docs.sparkSession)
    src, schema = narrowed(docs, id_col, text_col), "doc_id long, row long, n_words long, found array<struct<item_id:bigint,distance:int,end_word:bigint>>"
    slices = item_slices(benchmark, id_col=item_col, text_col=item_text_col)
    first, second = next(slices), next(slices, None)
    if second is None:
        held = spark.sparkContext.broadcast(Items(first))
        return src.withColumn("row", F.lit(0).cast("long")).mapInArrow(_marker(held), schema).select("doc_id", "n_words", "found")
    src = stored(src.withColumn("row", F.monotonically_increasing_id()), "texts")  # rows have the same number in every slice
    out, base = None, None
    for rows in itertools.chain([first, second], slices):
        held = spark.sparkContext.broadcast(Items(rows))
        part = src.mapInArrow(_marker(held), schema)
        if base is None:
            base = part = stored(part, "found")
        else:
            part = stored(part.filter("size(found) > 0"), "found")
        out = part.select("row", "found") if out is None else out.unionByName(part.select("row", "found"))
        held.unpersist()
    drop_table(src)
    all_found = out.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))  # items that one text holds
    return base.select("row", "doc_id", "n_words").join(all_found, "row").select("doc_id", "n_words", "found")


def contaminated(docs: DataFrame, benchmark: DataFrame, **cols: str) -> DataFrame:
    """``doc_id, n_words, contaminated, item_ids, distances`` for every document."""
    return matches(docs, benchmark, **cols).select("doc_id", "n_words", (F.size("found") > 0).alias("contaminated"), F.col("found.item_id").alias("item_ids"), F.col("found.distance").alias("distances"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    spark = prepare(docs.sparkSession)
    slices = item_slices(benchmark, id_col=item_col, text_col=item_text_col)
    rows = next(slices)
    while rows is not None:
        held, rows = spark.sparkContext.broadcast(Items(rows)), next(slices, None)

        def mask(piece: pa.RecordBatch, held=held) -> pa.Array:
            words, first = plain_words(*K.buffer_of(piece.column(text_col)))
            keep = np.ones(piece.num_rows, bool)
            keep[[row for row, *_ in held.value.search(words, first)]] = False
            return pa.array(keep)

        docs = rows_kept(docs, text_col, mask, BLOCK)
        if rows is not None:  # what is left is a table, so that one slice at a time is held
            docs = stored(docs, "clean")
            held.unpersist()
    return docs
