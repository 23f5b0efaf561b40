import base64
import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import byte_bpe, runtime
from quillgraph.llm import text_kernel as K

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t' 　asrtveldm1٣!…é漢😀", max_size=14), max_size=4))
def test_pretokens_are_the_matches_of_the_pattern(texts):
    buf, offs = K.buffer_of(pa.array(texts, pa.string()))
    starts = K.pretoken_starts(buf, offs)
    got = [bytes(buf[a:b]) for a, b in zip(starts, np.append(starts[1:], len(buf)))]
    assert got == [m.group().encode() for t in texts for m in regex.finditer(P.PATTERN, t)]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=90))
def test_merges_are_those_of_the_library(word):
    assert byte_bpe.merge_word(word, RANKS) == LIBRARY._encode_single_piece(word)


def test_varints():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**28, 2**33])
    data, offs = K.put_varints(v)
    got, ends = K.get_varints(data)
    assert got.tolist() == v.tolist() and ends.tolist() == offs[1:].tolist()


def test_round_trip_against_the_library(spark):
    texts = ["", None, "Hello  world's  end\n\n ok", "x" * 5000, "é漢😀 'll don't", " ", "same", "same", "the the the " * 4000]
    rows = [(i, t, b"0", 1) for i, t in enumerate(texts)] + [(None, "null id", b"", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary, block int").repartition(3)
    got = {r.doc_id: r for r in byte_bpe.round_trip(df, PATH).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    tokens = byte_bpe.encode(df, PATH)
    assert {r.doc_id: r.ids for r in tokens.collect()} == {i: LIBRARY.encode_ordinary(t or "") for i, t, *_ in rows}
    assert {r.doc_id: bytes(r["data"]).decode() for r in byte_bpe.decode(tokens, PATH).collect()} == {i: t or "" for i, t, *_ in rows}


def test_empty_table(spark):
    assert byte_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_rank_file_is_read_as_the_library_reads_it():
    with open(PATH, "rb") as f:
        assert len(RANKS) == sum(1 for _ in f) and base64.b64encode(next(iter(RANKS)))


def block_of(texts, monkeypatch):
    """The rows of one block of texts, as the last step gets them."""
    monkeypatch.setattr(byte_bpe.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return pa.Table.from_batches(list(byte_bpe._encoder(PATH)(byte_bpe._exploder(5)(iter([batch])))))


def many_words():
    rng = random.Random(7)
    return [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(200)) for _ in range(500)]


def test_texts_are_written_out_in_windows(monkeypatch):
    texts = ["", "one two", None, "x" * 300, "", "three four five six seven", "é漢😀 " * 9, "", ""]
    for window in (1, 3, 8, 1 << 16):
        monkeypatch.setattr(byte_bpe, "WINDOW", window, raising=False)
        for r, t in zip(byte_bpe._digests(PATH, True)(block_of(texts, monkeypatch)).to_pylist(), texts, strict=True):
            ids = LIBRARY.encode_ordinary(t or "")
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_a_block_is_written_out_without_objects_for_each_word(monkeypatch):
    texts = many_words()
    table, run = block_of(texts, monkeypatch), byte_bpe._digests(PATH, True)
    run(table)  # tables by id are made once
    tracemalloc.start()
    run(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * sum(map(len, texts))


def test_workers_give_back_what_a_task_held(monkeypatch):
    texts, held = many_words(), []
    block_of(texts, monkeypatch)
    monkeypatch.setattr(runtime, "release", lambda: held.append(tracemalloc.get_traced_memory()[0]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    tracemalloc.start()
    for _ in byte_bpe._exploder(5)(iter([batch])):
        pass
    tracemalloc.stop()
    assert held[-1] < sum(map(len, texts))
