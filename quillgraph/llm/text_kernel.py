"""Vectorised text work on Arrow buffers: words, hashes, pre-tokens and packed integers, without a loop over characters.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are 64 bits over the whole word and its length.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2, _M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))
#: Spans or pairs that are hashed at once.
PART = 1 << 17
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return buf + (((buf - np.uint8(65)) < np.uint8(26)).view(np.uint8) << np.uint8(5))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row of ``offs`` the index of its first word (with a last entry)."""
    return run_spans(~((buf == 32) | ((buf - np.uint8(9)) < np.uint8(5))), offs)


def plain_word_spans(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for runs of a-z, 0-9 and bytes of non-ASCII characters in lower-cased bytes: words without punctuation."""
    return run_spans(((low - np.uint8(97)) < np.uint8(26)) | ((low - np.uint8(48)) < np.uint8(10)) | (low >= 128), offs)


def run_spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked bytes that rows of ``offs`` cut."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes at a step; spans are taken in parts, which keeps what is held besides small."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), PART):
        out[a : a + PART] = _span_hashes(loads, starts[a : a + PART], ends[a : a + PART])
    return out


def _span_hashes(loads: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    left = ends - starts
    h = mix(left.astype(np.uint64) * _M3 + np.uint64(1))
    h = mix(h ^ (loads[starts] & _MASK[np.minimum(left, 8)]))
    live = np.flatnonzero(left > 8)
    at, left = starts[live] + 8, left[live] - 8
    while len(live):
        h[live] = mix(h[live] * _M3 ^ (loads[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), PART):
        x, y = a[i : i + PART], b[i : i + PART]
        out[i : i + PART] = mix(x * _M3 + (y ^ (y >> np.uint64(31))) + np.uint64(0x2545F4914F6CDD1D))
    return out


def take_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans one after the other, and their offsets."""
    lens = ends - starts
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    return buf[np.repeat(starts - offs[:-1], lens) + np.arange(offs[-1])], offs


def binary_array(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column over bytes and offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def put_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned integers below 2**35, seven bits a byte, and the byte offset of each."""
    v = np.ascontiguousarray(values)
    v = v.view(np.uint64) if v.dtype == np.int64 else v.astype(np.uint64)
    size = np.ones(len(v), np.uint8)
    for k in range(1, 5):
        size += v >= np.uint64(1 << (7 * k))
    offs = np.zeros(len(v) + 1, np.int64)
    np.cumsum(size, dtype=np.int64, out=offs[1:])
    out = np.zeros(offs[-1], np.uint8)
    for a in range(0, len(v), PART):
        _put(out, v[a : a + PART], size[a : a + PART], offs[:-1][a : a + PART])
    return out, offs


def _put(out: np.ndarray, v: np.ndarray, size: np.ndarray, at: np.ndarray) -> None:
    out[at] = (v & np.uint64(127)).astype(np.uint8) | ((size > 1).view(np.uint8) << np.uint8(7))
    for k in range(1, 5):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        byte = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[at[has] + k] = byte | ((size[has] > k + 1).view(np.uint8) << np.uint8(7))


def get_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of ``put_varints`` and the offset at which each one ends."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(5):
        has = ends - starts > k
        if not has.any():
            break
        out[has] |= (data[starts[has] + k] & 127).astype(np.int64) << (7 * k)
    return out, ends


def pack(*parts: np.ndarray) -> bytes:
    """Arrays of bytes as one compressed string."""
    sizes = np.array([len(parts), *(p.nbytes for p in parts)], np.int64)
    raw = sizes.tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``, as bytes."""
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    cuts = 8 * (n + 1) + np.concatenate([[0], np.cumsum(raw[8 : 8 * (n + 1)].view(np.int64))])
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_CLASS: list[np.ndarray] = []
SPACE, LETTER, NUMBER, OTHER = range(4)


def char_classes() -> np.ndarray:
    """The class of every code point: white space, letter, number, other. Made once in each worker."""
    if not _CLASS:
        table = np.full(0x110000, OTHER, np.uint8)
        first = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[:] = first
        # Unicode White_Space (fixed values)
        for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            table[c] = SPACE
        _CLASS.append(table)
    return _CLASS[0]


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = char_classes()
    out = table[:128][np.minimum(buf, 127)]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = np.concatenate([buf, np.zeros(4, np.uint8)])
        first = b[lead].astype(np.int32)
        size = 2 + (first >= 0xE0).astype(np.int32) + (first >= 0xF0)
        code = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            code = np.where(size > k, (code << 6) | (b[lead + k] & 0x3F), code)
        cls = table[code]
        for k in range(4):
            has = size > k
            out[lead[has] + k] = cls[has]
    return out


def pretoken_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start that the pattern of the byte-level vocabularies cuts a text into.

    The pattern: contractions ``'s 't 're 've 'm 'll 'd``; letters, numbers or other signs, each with at most one
    space before; white space, which leaves its last character to what follows.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(buf)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    new = edge[:-1].copy()
    new[1:] |= cls[1:] != cls[:-1]
    runs = np.flatnonzero(new).astype(np.int32 if n < 2**31 - 1 else np.int64)
    ends = np.append(runs[1:], runs.dtype.type(n))
    kind = cls[runs]
    joined = np.append(~edge[runs[1:]], False)  # the next run is of the same text
    flag = new
    last = ends - 1
    for _ in range(3):
        last = np.where((buf[last] & 0xC0) == 0x80, last - 1, last)
    lead = (kind == SPACE) & joined
    flag[last[lead]] = True
    lends = lead & (buf[last] == 32)  # its last space goes to the next run
    flag[ends[lends]] = False
    lent = np.concatenate([[False], lends[:-1]])
    quote = np.flatnonzero((kind == OTHER) & (ends - runs == 1) & (buf[runs] == 39) & joined & ~lent)
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        at, stop = ends[quote], ends[quote + 1]
        b = np.concatenate([buf, np.zeros(2, np.uint8)])
        one, two = b[at], b[at + 1]
        two = np.where(at + 1 < stop, two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 1, np.where(long, 2, 0))
        hit = size > 0
        flag[at[hit]] = False
        rest = at + size
        cut = hit & (rest < stop)
        flag[rest[cut]] = True
    return np.flatnonzero(flag)
