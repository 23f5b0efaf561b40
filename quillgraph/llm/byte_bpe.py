"""Byte-level BPE encoding and decoding of whole texts.

Global distinct-word shuffle: every block of texts is cut into pre-tokens, and each distinct word of the block leaves with
all its positions, packed by the task that its hash names. There the words of all blocks meet and each is encoded once; ids go
back with the positions, and each block is put together again by position. Decoding looks every id up in the token-byte table,
whose size is that of the vocabulary.

Null and empty texts have no tokens. Null ids stay null. Repeated rows give repeated results. Extra columns are not read.
Texts of any length are whole: a text longer than a block is a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_kernel as K
from .runtime import narrowed, partitions, pieces, prepare, release, released

#: Uses in a block from which a word is spread over all tasks. Rarer words stay in one.
HEAVY_USES = 2000
#: Bytes of text in a block: larger blocks name each distinct word less often.
WORD_BLOCK = 16 << 20
#: Bytes of text that are cut into pre-tokens at once.
RUN_BYTES = 1 << 20
#: Distinct words whose ids a task keeps.
KEPT_WORDS = 200_000
#: Words, and ids, of a block that are written out at once.
WINDOW = 1 << 16
#: Bytes up to which a word is scanned rather than kept in a heap; a rank above all ranks.
SCANNED, NO_RANK = 40, 1 << 40
_RANKS: dict[str, dict[bytes, int]] = {}
_TABLES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file; read once in each process."""
    if path not in _RANKS:
        with open(path, "rb") as f:
            _RANKS[path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _RANKS[path]


def token_tables(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By id: the token's bytes and their offsets, a comma with the decimal id and their offsets; made once in each process."""
    if path not in _TABLES:
        by_id = {i: token for token, i in load_ranks(path).items()}
        top = max(by_id, default=-1) + 1
        tables = []
        for row in ([by_id.get(i, b"") for i in range(top)], [b",%d" % i for i in range(top)]):
            tables += [np.frombuffer(b"".join(row), np.uint8), np.cumsum([0, *map(len, row)])]
        _TABLES[path] = tuple(tables)
    return _TABLES[path]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged, leftmost first, until none has a rank.

    Short words are scanned again after each merge; for long ones a heap of pairs over a linked list keeps to n log n.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    if n <= SCANNED:
        cut = list(range(n + 1))
        pair = [ranks.get(word[i : i + 2], NO_RANK) for i in range(n - 1)]
        while pair and (low := min(pair)) < NO_RANK:
            i = pair.index(low)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = ranks.get(word[cut[i] : cut[i + 2]], NO_RANK)
            if i:
                pair[i - 1] = ranks.get(word[cut[i - 1] : cut[i + 1]], NO_RANK)
        return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i]:
            continue
        j = end[i]
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, found for runs of whole texts one after the other: what is held besides is of the order of a run."""
    kind = np.int32 if len(buf) < 2**31 - 1 else np.int64
    edge = np.unique(np.append(np.searchsorted(offs, np.arange(0, len(buf), RUN_BYTES)), len(offs) - 1)).tolist()
    found = [(K.pretoken_starts(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) + offs[a]).astype(kind) for a, b in zip(edge, edge[1:])]
    return np.concatenate([np.zeros(0, kind), *found])


def _exploder(buckets: int):
    """Blocks of texts to rows (block, bucket, payload): the distinct words of a block that hash to a bucket, with all their
    positions. A first row, of bucket -1, holds the block's documents. Words with long position lists are in another bucket
    for each block, so that no task gathers the positions of a frequent word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for piece in pieces(batches, "text", WORD_BLOCK):
            ids, col = piece.column("doc_id"), piece.column("text")
            buf, offs = K.buffer_of(col)
            starts = _starts(buf, offs)
            ends = np.append(starts[1:], starts.dtype.type(len(buf)))
            counts = np.diff(np.searchsorted(starts, offs)).astype(np.int64)
            null = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8)
            rows = [(-1, K.pack(pc.fill_null(ids, 0).to_numpy().astype(np.int64), null, counts))]
            if len(starts):
                h = K.span_hashes(buf, starts, ends)
                hs = np.sort(h)
                distinct = hs[np.concatenate([[True], hs[1:] != hs[:-1]])]
                del hs
                key = np.searchsorted(distinct, h).view(np.uint64)
                del h
                key <<= np.uint64(32)
                key |= np.arange(len(key), dtype=np.uint64)
                key.sort()
                pos = (key & np.uint64(0xFFFFFFFF)).view(np.int64)
                key >>= np.uint64(32)
                rank = key
                del key
                first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
                del rank
                bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                heavy = np.diff(np.append(first, len(pos))) > HEAVY_USES
                bucket[heavy] = (bucket[heavy] + block * 7 + (block >> 32) * 13) % buckets
                order = np.lexsort((pos[first], bucket))  # within a bucket by first place, told as the step from the word before
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                gap = np.diff(pos, prepend=0)
                step = np.diff(pos[first[order]], prepend=0)
                opens = edge[:-1][np.diff(edge) > 0]
                step[opens] = pos[first[order[opens]]]
                gap[first[order]] = step
                at, each = K.put_varints(gap)
                at_cut = each[np.append(first, len(gap))]
                del gap, each
                for b in range(buckets):
                    mine = order[edge[b] : edge[b + 1]]
                    if len(mine):
                        where = pos[first[mine]]
                        words, word_offs = K.take_spans(buf, starts[where], ends[where])
                        places, place_offs = K.take_spans(at, at_cut[mine], at_cut[mine + 1])
                        rows.append((b, K.pack(words, K.put_varints(np.diff(word_offs))[0], places, K.put_varints(np.diff(place_offs))[0])))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "bucket", "payload"])
            block += 1

    return released(run)


def _encoder(ranks_path: str):
    """Replaces the words of a payload by their ids. A word meets its rows of all blocks in one task, which encodes it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, kept = load_ranks(ranks_path), {}
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                row = batch.slice(i, 1)
                if bucket >= 0:
                    words, sizes, places, place_sizes = K.unpack(row.column("payload")[0].as_py())
                    raw, cut = words.tobytes(), [0, *np.cumsum(K.get_varints(sizes)[0]).tolist()]
                    found = []
                    for w in (raw[a:b] for a, b in zip(cut, cut[1:])):
                        ids = kept.get(w)
                        if ids is None:
                            if len(kept) >= KEPT_WORDS:
                                kept.clear()
                            ids = kept[w] = np.array(merge_word(w, ranks), np.int32).tobytes()
                        found.append(ids)
                    flat = np.frombuffer(b"".join(found), np.int32)
                    payload = K.pack(K.put_varints(flat)[0], K.put_varints(np.fromiter(map(len, found), np.int64, len(found)) >> 2)[0], places, place_sizes)
                    row = pa.RecordBatch.from_arrays([*row.columns[:2], pa.array([payload], pa.binary())], ["block", "bucket", "payload"])
                yield row

    return released(run)


class Block:
    """The documents of one block with their ids in order: ``edges`` of ``ids`` by document."""

    def __init__(self, table: pa.Table):
        buckets, payload = table.column("bucket").to_pylist(), table.column("payload")
        ids, null, counts = K.unpack(payload[buckets.index(-1)].as_py())
        self.doc_ids = pa.array(ids.view(np.int64), mask=null.astype(bool))
        words = np.concatenate([[0], np.cumsum(counts.view(np.int64))])
        word_at = np.zeros(int(words[-1]), np.int32)
        all_ids, all_sizes, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for row, bucket in enumerate(buckets):
            if bucket < 0:
                continue
            flat, sizes, places, place_sizes = K.unpack(payload[row].as_py())
            all_ids.append(K.get_varints(flat)[0].astype(np.int32))
            all_sizes.append(K.get_varints(sizes)[0])
            gaps, ends = K.get_varints(places)
            bounds = np.searchsorted(ends, np.cumsum(K.get_varints(place_sizes)[0]), side="right")
            first = np.concatenate([[0], bounds[:-1]])
            pos = np.cumsum(gaps)
            uses = bounds - first
            pos -= np.repeat(pos[first] - np.cumsum(gaps[first]), uses)
            word_at[pos] = np.repeat(np.arange(n, n + len(uses), dtype=np.int32), uses)
            n += len(uses)
        by_word, size = np.concatenate(all_ids), np.concatenate(all_sizes)
        del all_ids, all_sizes
        cut = np.concatenate([[0], np.cumsum(size)])
        made, self.edges, done = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64), 0
        for a in range(0, len(word_at), WINDOW):
            at = word_at[a : a + WINDOW]
            some, offs = K.take_spans(by_word, cut[at], cut[at + 1])
            here = slice(*np.searchsorted(words, [a + 1, a + len(at) + 1]))  # documents that end in the window; empty ones where the one before does
            self.edges[here] = done + offs[words[here] - a]
            made.append(some)
            done += len(some)
        self.ids = np.concatenate(made)

    def sequences(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.edges, pa.int32()), pa.array(self.ids, pa.int32()))

    def digests(self, ranks_path: str) -> tuple[list[str], list[str]]:
        """Of the ids of each document joined by commas, and of the bytes decoded from them; ids are looked up in windows."""
        token, token_cut, comma, comma_cut = token_tables(ranks_path)
        edges, out, at = self.edges.tolist(), ([], []), 0
        ids, data = hashlib.sha256(), hashlib.sha256()
        for a in range(0, max(len(self.ids), 1), WINDOW):
            some = self.ids[a : a + WINDOW]
            texts, text_offs = K.take_spans(comma, comma_cut[some], comma_cut[some + 1])
            decoded, offs = K.take_spans(token, token_cut[some], token_cut[some + 1])
            end = a + len(some)
            while at < len(edges) - 1:
                low, high = max(edges[at], a) - a, min(edges[at + 1], end) - a
                if low < high:
                    ids.update(texts[text_offs[low] + (edges[at] >= a) : text_offs[high]])  # no comma before the first
                    data.update(decoded[offs[low] : offs[high]])
                if edges[at + 1] > end:
                    break
                out[0].append(ids.hexdigest())
                out[1].append(data.hexdigest())
                ids, data, at = hashlib.sha256(), hashlib.sha256(), at + 1
        return out


def _written(columns: Callable[[Block], dict[str, pa.Array]]):
    """A table of columns for each block; what the block held is given back before the next."""

    def made(table: pa.Table) -> pa.Table:
        block = Block(table)
        return pa.table({"doc_id": block.doc_ids} | columns(block))

    def run(table: pa.Table) -> pa.Table:
        out = made(table)
        release()
        return out

    return run


def _digests(ranks_path: str, with_ids: bool = False):
    def columns(block: Block) -> dict[str, pa.Array]:
        ids, decoded = block.digests(ranks_path)
        found = {"n_tokens": pa.array(np.diff(block.edges)), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        return found | ({"ids": block.sequences()} if with_ids else {})

    return _written(columns)


def _sequences(table: pa.Table) -> pa.Table:
    return _written(lambda block: {"ids": block.sequences()})(table)


def encoded_words(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (block, bucket, payload): the ids of the distinct words of a block with their positions there."""
    spark = prepare(docs.sparkSession)
    n = partitions(spark)
    schema = "block long, bucket int, payload binary"
    rows = narrowed(docs, id_col, text_col).mapInArrow(_exploder(n), schema)
    target = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod("block", F.lit(n)).cast("int"))
    return rows.repartitionById(n, target).mapInArrow(_encoder(ranks_path), schema)


def encode(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text, null texts as empty."""
    return encoded_words(docs, ranks_path, id_col=id_col, text_col=text_col).groupBy("block").applyInArrow(_sequences, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``data`` (binary) of id sequences, each id looked up in the token-byte table; null ids of a row as none."""
    prepare(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        token_bytes = dict(zip(ranks.values(), ranks.keys(), strict=True))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([b"".join([token_bytes[i] for i in x or ()]) for x in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "data"])

    return tokens.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, SHA-256 of the ids joined by commas, and SHA-256 of the bytes decoded from them."""
    words = encoded_words(docs, ranks_path, id_col=id_col, text_col=text_col)
    return words.groupBy("block").applyInArrow(_digests(ranks_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``round_trip`` with the ids as well."""
    words = encoded_words(docs, ranks_path, id_col=id_col, text_col=text_col)
    return words.groupBy("block").applyInArrow(_digests(ranks_path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
