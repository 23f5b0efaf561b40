import zlib

import numpy as np

from quillgraph.llm import sharding


def test_permutation_is_a_bijection_with_inverse():
    for rows in (1, 2, 3, 5, 16, 17, 1000, 4097):
        p = sharding.permute(np.arange(rows), rows, seed=3)
        assert sorted(p.tolist()) == list(range(rows))
        assert sharding.permute(p, rows, seed=3, back=True).tolist() == list(range(rows))


def test_place_and_origin_agree():
    for r in (0, 7, 99):
        assert sharding.origin(*sharding.place(r, 100, 16), 100, 16) == r


def test_shards_are_level_and_slots_have_no_gaps(spark):
    texts = ["", None, "é", "same", "same"] + [f"text {i}" for i in range(200)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "n", "y"), (3, "same", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    got = sharding.shard(df, 16).collect()
    assert len(got) == len(rows)
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].size == 1 and by_id[1].text_crc32 == 0 and by_id[2].size == 3
    assert by_id[2].text_crc32 == zlib.crc32("é".encode())
    for r in got:
        assert (r.shard, r.slot) == sharding.place(r.row_number, len(rows), 16) and r.law == "rows" and r.grown_shard is None
    again = sharding.shard(df.repartition(2), 16).collect()
    assert sorted((r.doc_id or -1, r.shard, r.slot) for r in got) == sorted((r.doc_id or -1, r.shard, r.slot) for r in again)


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shards_against_a_plain_loop(spark):
    """Order, walk and cut made anew: a Feistel network over whole numbers, one row at a time."""
    mask = 2**64 - 1

    def mix(x, key):
        x ^= key
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def walk(x, n, seed):
        bits = max(2, (n - 1).bit_length())
        b = bits - bits // 2
        a = bits - b
        while True:
            left, right = x >> b, x & ((1 << b) - 1)
            for k in range(6):
                key = ((seed * 2 + 1) * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & mask
                if k % 2:
                    left ^= mix(right, key) & ((1 << a) - 1)
                else:
                    right ^= mix(left, key) & ((1 << b) - 1)
            x = (left << b) | right
            if x < n:
                return x

    rows = [(i * 37 % 211, "t" * (i % 50)) for i in range(211)] + [(5, None), (5, "x" * 100_000)]
    order = sorted((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    for seed in (0, 9):
        want = sorted((i, size, crc, *divmod(walk(k, len(rows), seed), 16)[::-1]) for k, (i, crc, size) in enumerate(order))
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 16, seed=seed).collect()
        assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == want
