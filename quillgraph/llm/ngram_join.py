"""Exact Jaccard self-join of word shingle sets, as a T-occurrence search over inverted lists (DivideSkip).

Documents with equal sets form a class, which takes part once. For a set of ``n`` shingles a partner needs an overlap of
``ceil(p * n)`` at least, so among its ``n`` inverted lists all but ``ceil(p * n) - c`` must hold any partner ``c`` times.
The short lists are those of the shingles that are rarest in a common order; a shuffle by shingle brings each list together,
a shuffle by document brings a document's short lists together, and merging them keeps the ids that occur ``c`` times. The long
lists are never built: whether a candidate is in them is probed by binary search in the candidate's own sorted set.

Before texts are read again for that, a pair must pass a bound that loses nothing: the counts of the two sets in 128 parts of
the hash range differ by no more than the sets do.

The common order comes from a sketch of fixed size that puts frequent shingles last; it changes the work, never the result.
Two rounds: first every list's members are tried against a few pivots of the list, and what is verified joins components; then the
lists are searched in full, but only between different components. So a large group of near copies costs its size, not its square,
while no link between different components is lost.

No task gets a whole long list. A list longer than ``LONG_SHARE`` of all entries (and HEAVY) has its pivots from an aggregation, and its
members meet them by a broadcast whose size those two bound. In the second round such a list is dealt in parts of ``PART``
members, and each pair of parts is searched by a task of its own.

Sets: lower-cased words (A-Z only), distinct shingles of ``words`` words; a shorter text is one shingle, a text without words
has none and links with nothing. Null texts are empty. A row without id has a set but no links, and its component is that of an
equal set if one has an id. Repeated rows and ids are rows of their own with one class. Ties (a similarity exactly at the
limit) link. A very long text is one set like any other, made in one piece by one task, in memory of the order of the text.
Empty tables give empty results. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_kernel as K
from .components import components
from .members import only, renamed, without
from .runtime import drop_table, narrowed, partitions, pieces, prepare, released, stored

#: Buckets of the sketch (a power of two) and its segments.
SKETCH_BITS, SEGMENTS = 20, 64
#: A candidate must be in one short list for every so many shingles of the smaller set, rounded up.
PER_LIST = 32
#: Members from which a list has several pivots, and how many.
LONG_LIST, PIVOTS = 12, 8
#: So many of the largest components are told by their size when a pair between two components is named.
LARGE = 1000
ENTRY = "token long, node long, n int"
#: Pairs of a list that a task holds before it hands them on.
HELD = 1 << 18
#: Parts of the hash range whose counts bound a distance from below.
SHAPE = 128
#: A list is long for a task from so many entries, if that is also more than one entry in LONG_SHARE; members of a part of a list.
HEAVY, LONG_SHARE, PART = 20_000, 4096, 10_000


def shingles(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and for each row of ``offs`` where its shingles start (with a last entry)."""
    buf = K.lower_ascii(buf)
    starts, ends, first = K.word_spans(buf, offs)
    h = K.span_hashes(buf, starts, ends)
    n = np.diff(first)
    out_n = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    cuts = np.concatenate([[0], np.cumsum(out_n)])
    g = h
    for k in range(1, words):
        g = K.pair_hash(g[:-1], h[k:]) if len(g) > 1 else g[:0]
    out = np.zeros(cuts[-1], np.uint64)
    full = np.flatnonzero(n >= words)
    if len(full):
        at = np.repeat(first[full] - cuts[full], out_n[full]) + np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in full])
        out[np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in full])] = g[at]
    for i in np.flatnonzero((n > 0) & (n < words)).tolist():
        x = K.mix(h[first[i] : first[i] + 1] ^ np.uint64(n[i]))
        for j in range(first[i] + 1, first[i + 1]):
            x = K.pair_hash(x, h[j : j + 1])
        out[cuts[i]] = x[0]
    return out, cuts


def distinct_sets(flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, once each."""
    flat = flat.copy()
    edges = cuts.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[cuts[:-1][cuts[:-1] < len(flat)]] = True
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def signatures(flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit signatures of each set."""
    return _sums(K.mix(flat), cuts).view(np.int64), _sums(K.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), cuts).view(np.int64)


def _sketcher(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for piece in pieces(batches, "text"):
            flat, _ = shingles(*K.buffer_of(piece.column("text")), words)
            total += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            parts = [(i, K.pack(K.put_varints(x)[0])) for i, x in enumerate(total.reshape(SEGMENTS, -1)) if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["segment", "counts"])

    return released(run)


def _merge_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, x in zip(b.column("segment").to_pylist(), b.column("counts").to_pylist(), strict=True):
            v = K.get_varints(K.unpack(x)[0])[0]
            sums[i] = sums[i] + v if i in sums else v
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([K.pack(K.put_varints(np.minimum(x, (1 << 35) - 1))[0]) for x in sums.values()], pa.binary())], ["segment", "counts"])


def frequency_order(docs: DataFrame, words: int) -> np.ndarray:
    """For each bucket of hashes 0, or how far (in quarters of a power of two) its count is above four times the mean."""
    spark = docs.sparkSession
    schema = "segment int, counts binary"
    rows = docs.mapInArrow(_sketcher(words), schema)
    n = min(SEGMENTS, partitions(spark))
    merged = rows.repartitionById(n, F.col("segment") % n).mapInArrow(released(_merge_sketch), schema).collect()  # of fixed size
    counts = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS))
    for r in merged:
        counts[r["segment"]] = K.get_varints(K.unpack(bytes(r["counts"]))[0])[0]
    counts = counts.ravel()
    return np.clip(np.floor(4 * np.log2(np.maximum(counts / max(counts.mean(), 1.0) / 4, 1))), 0, 255).astype(np.uint8)


def required(n: np.ndarray) -> np.ndarray:
    """In how many short lists of a set of ``n`` a partner that is not smaller must be."""
    return -(-n // PER_LIST)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many short lists a set of ``n`` needs; none where only equal sets can link."""
    length = n + percent * n // -100 + required(n)
    return np.where(100 * n >= percent * (n + 1), np.minimum(length, n), 0)


def _features(words: int, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(order.value, np.uint8)
        for piece in pieces(batches, "text"):
            flat, cuts = distinct_sets(*shingles(*K.buffer_of(piece.column("text")), words))
            s1, s2 = signatures(flat, cuts)
            n = np.diff(cuts)
            take = prefix_length(n, percent)
            key = (rank[(flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (flat >> np.uint64(8))
            out = []
            for a, b, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), take.tolist(), strict=True):
                x = key[a:b]
                if t:
                    x.sort()
                out.append(x[:t].tobytes())
            where = np.repeat(np.arange(len(n)), n) * SHAPE + (flat >> np.uint64(57)).astype(np.int64)
            shape = np.minimum(np.bincount(where, minlength=len(n) * SHAPE), 255).astype(np.uint8)
            shapes = K.binary_array(shape, np.arange(len(n) + 1) * SHAPE)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("h"), pa.array(n, pa.int32()), pa.array(s1), pa.array(s2), pa.array(out, pa.binary()), shapes], ["doc_id", "h", "n", "s1", "s2", "short", "shape"])

    return released(run)


def _postings(frequent: bool = False):
    """Entries of the short lists; those alone whose token is in a bucket that the common order calls frequent (its top byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = K.buffer_of(b.column("short"))
            size = np.diff(offs) // 8
            token, node, n = data.view(np.int64), np.repeat(b.column("node").to_numpy(), size), np.repeat(b.column("n").to_numpy(), size)
            if frequent:
                mine = token.view(np.uint64) >> np.uint64(56) > 0
                token, node, n = token[mine], node[mine], n[mine]
            rows = pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(n)], ["token", "node", "n"])
            yield from (rows.slice(i, 100_000) for i in range(0, rows.num_rows, 100_000))

    return released(run)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Sorted batches as columns with the starts of runs of equal keys (and a last entry); no run is cut."""
    held: dict[str, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
        cols = {c: np.concatenate([held[c], x]) if held else x for c, x in cols.items()}
        new = cols[keys[0]][1:] != cols[keys[0]][:-1]
        for k in keys[1:]:
            new |= cols[k][1:] != cols[k][:-1]
        starts = np.flatnonzero(np.concatenate([[True], new]))
        last = starts[-1]
        held = {c: x[last:] for c, x in cols.items()}
        if last:
            yield {c: x[:last] for c, x in cols.items()}, starts
    if held:
        yield held, np.array([0, len(held[keys[0]])])


def _lists(percent: int):
    """Lists of two or more, each member with the pivots it is tried against and the lists that such a pair must share.

    A short list has one pivot, its smallest set. A long one has several, those first by a hash of the document, so that all
    lists of a group of near copies name the same ones. A pair is named once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in runs(batches, "token"):
            size = np.diff(starts)
            many = size > 1
            if not many.any():
                continue
            keep = np.repeat(many, size)
            node, n, token = cols["node"][keep], cols["n"][keep].astype(np.int64), cols["token"][keep]
            size = size[many]
            first = np.cumsum(size) - size
            long = size >= LONG_LIST
            member = np.flatnonzero(~np.repeat(long, size))
            pairs = [np.stack([member, np.repeat(first, size)[member]])]
            for a, m in zip(first[long].tolist(), size[long].tolist(), strict=True):
                order = a + np.argsort(K.mix(node[a : a + m].view(np.uint64)), kind="stable")
                for k in range(min(PIVOTS, m)):
                    pairs.append(np.stack([order[k + 1 :], np.full(m - k - 1, order[k])]))
            member, pivot = np.concatenate(pairs, axis=1)
            low, high = np.minimum(n[member], n[pivot]), np.maximum(n[member], n[pivot])
            fit = (member != pivot) & (100 * low >= percent * high)
            member, pivot, low = member[fit], pivot[fit], low[fit]
            order = np.argsort(member, kind="stable")
            offs = np.searchsorted(member[order], np.arange(len(node) + 1)).astype(np.int32)
            pivots = pa.ListArray.from_arrays(pa.array(offs), pa.array(node[pivot[order]]))
            needs = pa.ListArray.from_arrays(pa.array(offs), pa.array(required(low[order]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(n.astype(np.int32)), pivots, needs], ["token", "node", "n", "pivots", "needs"])

    return released(run)


def _allowed(x: np.ndarray, y: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether shapes allow a link: the distance of the counts is at most that of the sets."""
    return np.abs(x - y).sum(axis=1) * (100 + percent) <= total * (100 - percent)


def _turned(found: list[tuple[np.ndarray, int]], node: np.ndarray, n: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
    """Pairs found from a member (the second) but named by the others: one row for each of these, with its partners."""
    if not found:
        return []
    x, y = np.concatenate([at for at, _ in found]), np.repeat([i for _, i in found], [len(at) for at, _ in found])
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    edges = [*np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist(), len(x)]
    return [(int(node[x[a]]), int(n[x[a]]), node[y[a:b]].tobytes(), n[y[a:b]].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _named(out: list[tuple[int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(out), 5000):
        part = list(zip(*out[k : k + 5000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.binary()), pa.array(part[3], pa.binary())], ["node", "n", "ids", "sizes"])


def _across(percent: int, large):
    """For lists with several components, or pairs of parts of them (then ``side`` is 1 or 2): each document's partners in other
    components, and on the other side, whose size allows a link.

    Pairs are looked for from outside the list's largest component, but a pair has the same name in every list, as its lists are
    counted under that: the one whose component comes later in ``large`` or is not in it, else the smaller set. A pair is named
    only if the shapes of its sets allow a link, which every list says alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(large.value, np.int64)  # largest first
        by_id = np.argsort(known, kind="stable")
        for cols, starts in runs(batches, "token", "low", "high"):
            comp = cols["comp"]
            mixed = np.add.reduceat(np.concatenate([[False], comp[1:] != comp[:-1]]).astype(np.int64), starts[:-1])
            out: list[tuple[int, int, bytes, bytes]] = []
            for a, b in zip(starts[:-1][mixed > 0].tolist(), starts[1:][mixed > 0].tolist(), strict=True):
                c, node, n, side = comp[a:b], cols["node"][a:b], cols["n"][a:b].astype(np.int64), cols["side"][a:b]
                names, counts = np.unique(c, return_counts=True)
                if len(names) < 2:
                    continue
                main = names[counts.argmax()]
                place = np.zeros(len(names), np.int64)
                if len(known):
                    at = by_id[np.minimum(np.searchsorted(known[by_id], names), len(known) - 1)]
                    place = np.where(known[at] == names, len(known) - at, 0)
                rank = place[np.searchsorted(names, c)] * len(c) + np.arange(len(c))
                shape = np.frombuffer(b"".join(cols["shape"][a:b]), np.uint8).reshape(-1, SHAPE).astype(np.int16)
                low = np.searchsorted(n, -(-percent * n // 100))
                high = np.searchsorted(n, 100 * n // percent, side="right")
                turned: list[tuple[np.ndarray, int]] = []
                held = 0
                for i in np.flatnonzero(c != main).tolist():
                    at = np.arange(low[i], high[i])
                    at = at[(c[at] != c[i]) & ((c[at] == main) | (at > i)) & ((side[at] != side[i]) | (side[i] == 0))]
                    at = at[_allowed(shape[at], shape[i], n[at] + n[i], percent)]
                    mine = at[rank[at] > rank[i]]
                    if len(mine):
                        out.append((int(node[i]), int(n[i]), node[mine].tobytes(), n[mine].tobytes()))
                    if len(mine) < len(at):
                        turned.append((at[rank[at] < rank[i]], i))
                    held += len(at)
                    if held >= HELD:
                        out += _turned(turned, node, n)
                        yield from _named(out)
                        turned, out, held = [], [], 0
                out += _turned(turned, node, n)
            yield from _named(out)

    return released(run)


def divide_skip(lists: list[np.ndarray], t: int, long: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids that are in at least ``t`` of the sorted lists, and in how many.

    The ``long`` longest lists are set apart (by default t / (0.01 * log2(longest) + 1)); the rest are merged, ids in at least
    t - long of them go on, and each is probed in the long lists by binary search.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if long is None:
        long = int(t / (0.01 * np.log2(max(len(lists[-1]), 2)) + 1))
    long = max(0, min(long, t - 1, len(lists) - 1))
    merged = np.sort(np.concatenate(lists[: len(lists) - long]))
    start = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
    ids, seen = merged[start], np.diff(np.append(start, len(merged)))
    ids, seen = ids[seen >= t - long], seen[seen >= t - long]
    for x in lists[len(lists) - long :]:
        at = np.minimum(np.searchsorted(x, ids), len(x) - 1)
        seen = seen + (x[at] == ids)
    return ids[seen >= t], seen[seen >= t]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's short lists merged: candidates that occur often enough. Smaller partners need fewer lists."""
    for cols, starts in runs(batches, "node"):
        left, right = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            lists = [np.frombuffer(x, np.int64) for x in cols["ids"][a:b]]
            ids, size = np.concatenate(lists), np.concatenate([np.frombuffer(x, np.int64) for x in cols["sizes"][a:b]])
            need = required(np.minimum(size, int(cols["n"][a])))
            found, seen = divide_skip([np.sort(x) for x in lists], int(need.min()))
            if len(found):
                order = np.argsort(ids, kind="stable")
                found = found[seen >= need[order][np.searchsorted(ids[order], found)]]
            left.append(np.full(len(found), cols["node"][a]))
            right.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right).astype(np.int64))], ["a", "b"])


def _near(percent: int):
    """Pairs whose shapes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (K.buffer_of(b.column(c))[0].reshape(-1, SHAPE).astype(np.int16) for c in ("shape_a", "shape_b"))
            total = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            keep = pa.array(_allowed(x, y, total, percent))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return released(run)


def near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by the shapes of their sets. Loses none that does."""
    of = lambda c: reps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("shape").alias(f"shape_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return stored(both.select("a", "b", "n_a", "n_b", "shape_a", "shape_b").mapInArrow(_near(percent), "a long, b long"), "pairs")


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            flat, cuts = distinct_sets(*shingles(*K.buffer_of(piece.column("text")), words))
            s1, s2 = signatures(flat, cuts)
            mine = np.flatnonzero((s1 == piece.column("s1").to_numpy()) & (s2 == piece.column("s2").to_numpy()))
            data = [flat[cuts[i] : cuts[i + 1]].tobytes() for i in mine.tolist()]
            yield pa.RecordBatch.from_arrays([piece.column("node").take(pa.array(mine)), pa.array(data, pa.binary())], ["node", "shingles"])

    return released(run)


def _probe(percent: int):
    """Binary search of the smaller set's shingles in the larger set: the long lists, seen from the candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return released(run)


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of classes whose sets, made anew from the texts of their representatives, link. Stored."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    owners = stored(reps.select("node", "doc_id", "s1", "s2").join(need, "node", "left_semi"), "owners")
    texts = only(docs.filter("doc_id is not null").select("doc_id", "text"), ["doc_id"], owners)
    made = texts.select("node", "s1", "s2", "text").mapInArrow(_set_rows(words), "node long, shingles binary")
    sets = stored(made.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")  # one of repeated rows
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    links = stored(both.select("a", "b", "sa", "sb").mapInArrow(_probe(percent), "a long, b long"), "verified")
    drop_table(sets)
    drop_table(owners)
    return links


def classes(features: DataFrame) -> DataFrame:
    """One row for each set, with its least id and a 64-bit name: its first signature, or where sets share that (a few at 10**10 sets),
    a hash of both. Stored."""
    sets = features.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("short").alias("short"), F.first("shape").alias("shape"))
    sets = stored(sets, "classes")
    shared = stored(sets.groupBy("s1").agg(F.count("*").alias("c")).filter("c > 1").select("s1", F.lit(True).alias("shared")), "shared")
    if shared.isEmpty():
        drop_table(shared)
        return sets.withColumn("node", F.col("s1"))
    return sets.join(shared, "s1", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("s1", "s2", "n")).otherwise(F.col("s1"))).drop("shared")


def _long_lists(short: DataFrame) -> DataFrame | None:
    """Tokens whose lists are long, with their parts and up to PIVOTS pivots, those first by a hash; at most LONG_SHARE tokens, or None.
    Only a token in a frequent bucket can have one."""
    entries = short.agg(F.coalesce(F.sum(F.octet_length("short") / 8), F.lit(0)).cast("long")).first()[0]
    posted = short.mapInArrow(_postings(True), ENTRY)
    counts = stored(posted.groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > max(HEAVY, entries // LONG_SHARE)), "long")
    if counts.isEmpty():
        drop_table(counts)
        return None
    h = F.xxhash64("node")
    best = posted.join(F.broadcast(counts), "token").groupBy("token", F.pmod(h, F.lit(PIVOTS)).alias("k")).agg(F.min_by(F.struct("node", "n"), h).alias("p"), F.first("c").alias("c"))
    out = stored(best.groupBy("token").agg(F.sort_array(F.collect_list("p")).alias("p"), F.ceil(F.first("c") / PART).cast("int").alias("parts")), "long")
    drop_table(counts)
    return out


def _tries(short: DataFrame, long: DataFrame | None, percent: int, n: int) -> DataFrame:
    """``token, node, n, pivots, needs`` of the members of lists of two or more. Stored."""
    posted = short.mapInArrow(_postings(), ENTRY)
    schema = f"{ENTRY}, pivots array<bigint>, needs array<int>"
    light = posted if long is None else posted.join(F.broadcast(long.select("token")), "token", "left_anti")
    lists = light.repartition(n, "token").sortWithinPartitions("token", "n", "node").mapInArrow(_lists(percent), schema)
    if long is None:
        return stored(lists, "lists")
    fits = lambda p: (p["node"] != F.col("node")) & (F.least(p["n"], F.col("n")) * 100 >= F.greatest(p["n"], F.col("n")) * percent)
    mine = short.mapInArrow(_postings(True), ENTRY).join(F.broadcast(long), "token").withColumn("p", F.filter("p", fits))  # LONG_SHARE * PIVOTS pivots at most
    need = F.transform("p", lambda p: F.ceil(F.least(p["n"], F.col("n")) / F.lit(PER_LIST)).cast("int"))
    return stored(lists.unionByName(mine.select("token", "node", "n", F.transform("p", lambda p: p["node"]).alias("pivots"), need.alias("needs"))), "lists")


def _blocks(lists: DataFrame, comps: DataFrame, reps: DataFrame, long: DataFrame | None) -> DataFrame:
    """The members of lists with component and shape; those of long lists once for each pair of parts that they are in."""
    known = reps.select("node", "shape").join(comps, "node", "left").select("node", "shape", F.coalesce("comp", "node").alias("comp"))
    tagged = lists.select("token", "node", "n").join(known, "node")
    if long is None:
        return tagged.withColumns({"low": F.lit(0), "high": F.lit(0), "side": F.lit(0)})
    parts = tagged.join(F.broadcast(long.select("token", "parts")), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    block = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, "part").alias("low"), F.greatest(q, "part").alias("high"), F.when(q == F.col("part"), 0).when(F.col("part") < q, 1).otherwise(2).alias("side")))
    return parts.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("token", "node", "n", "comp", "shape", F.inline(block))


def _linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs(doc_id, text)``: features with ``node`` for every row, the classes, and the components of nodes with links."""
    spark = prepare(docs.sparkSession)
    n = partitions(spark)
    order = spark.sparkContext.broadcast(frequency_order(docs, words).tobytes())  # 1 MB, whatever the input
    src = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    features = stored(src.mapInArrow(_features(words, percent, order), "doc_id long, h long, n int, s1 long, s2 long, short binary, shape binary"), "features")
    reps = classes(features)
    short = reps.filter("doc_id is not null and octet_length(short) > 0").select("node", "n", "short")
    long = _long_lists(short)
    lists = _tries(short, long, percent, n)
    tried = lists.select("node", F.inline(F.arrays_zip("pivots", "needs"))).select(F.least("node", "pivots").alias("a"), F.greatest("node", "pivots").alias("b"), "needs")
    first = tried.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("needs").alias("t")).filter("c >= t").select("a", "b")
    pairs = near(first, reps, percent)
    links = verified(pairs, reps, docs, words, percent)
    comps = components(links)
    drop_table(links)
    top = comps.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(LARGE).collect()  # of fixed size
    large = spark.sparkContext.broadcast([r["comp"] for r in top])
    across = _blocks(lists, comps, reps, long).repartition(n, "token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "node").mapInArrow(_across(percent, large), "node long, n int, ids binary, sizes binary")
    second = stored(across.repartition(n, "node").sortWithinPartitions("node").mapInArrow(released(_search), "a long, b long").distinct(), "pairs")
    more = verified(second, reps, docs, words, percent)
    for done in (lists, pairs, second, *([] if long is None else [long])):
        drop_table(done)
    found, comps = comps, components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionAll(more))  # stars hold what the links did
    for done in (found, more):
        drop_table(done)
    rows, shared = features.select("doc_id", "h", "n", "s1", "s2"), reps.filter("node <> s1").select("n", "s1", "s2", "node")
    if shared.isEmpty():
        return rows.withColumn("node", F.col("s1")), reps, comps
    return rows.join(shared, ["n", "s1", "s2"], "left").withColumn("node", F.coalesce("node", "s1")), reps, comps


def join(docs: DataFrame, *, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id``: the smallest id that links reach, and the smallest id with an equal set."""
    rows, reps, comps = _linked(narrowed(docs, id_col, text_col), words, percent)
    smallest = reps.select("node", F.col("doc_id").alias("class_id")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = smallest.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    ids = smallest.join(low, "comp").select("node", "class_id", "component_id")
    own = lambda c: F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return rows.join(ids, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), own("component_id"), own("class_id"))


def deduplicated(docs: DataFrame, *, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all columns: that with the smallest id, and of several texts with that id the first by
    a hash of the text; of repeated rows with that id and text one. Documents that no link joins stay, whatever other rows have
    their id. Rows without an id and texts without words are in no component and stay, repeated or not. Rows that clearly stay are
    not shuffled, of the others whole rows once."""
    src, names = renamed(docs)
    at, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows, reps, comps = _linked(narrowed(docs, id_col, text_col), words, percent)
    in_groups = rows.filter("n > 0 and doc_id is not null").join(comps, "node", "left").select(F.coalesce("comp", "node").alias("comp"), F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    seen = stored(in_groups.groupBy("_id", "_h").agg(F.first("comp").alias("comp"), F.count("*").alias("c")), "seen")  # a text is in one component
    first = seen.groupBy("comp").agg(F.min(F.struct("_id", "_h")).alias("f")).select("f._id", "f._h")
    for done in (rows, reps, comps):
        drop_table(done)
    stays = ["_id", "_h"]
    gone, many = stored(seen.join(first, stays, "left_anti").select(*stays), "gone"), stored(seen.filter("c > 1").join(first, stays, "left_semi").select(*stays), "many")
    key: list[Column] = [F.col(at).cast("long").alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_h")]
    kept = without(src.select(*names, *key), stays, gone.union(many)).select(*names)
    if not many.isEmpty():
        one = only(src.select(*names, *key), stays, many).groupBy(*stays).agg(F.first(F.struct(*names)).alias("r"))
        kept = kept.unionByName(one.select("r.*"))
    return kept.toDF(*docs.columns)


#: The same in DuckDB for the given shingles and limit.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2))),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ov AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM ov JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM (SELECT doc_id, array_to_string(list_sort(list(s)), chr(10)) AS k FROM sh GROUP BY doc_id))
SELECT doc_id, coalesce(n, 0) AS n_shingles, c.component_id, coalesce(class_id, doc_id) AS class_id
FROM documents LEFT JOIN sz USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id) LEFT JOIN cl USING (doc_id)
"""
