import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import byte_bpe


def test_stages_filter_mask_and_encode(spark):
    sf = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == first.columns and 0.5 * docs.count() < out.count() <= docs.count()
        docs = out
    kept = {r.doc_id: r.text for r in docs.collect()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == len(kept)
    for r in last:
        assert r.ids == library.encode_ordinary(kept[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing names and empty tables, stage by stage."""
    word = lambda i, k: f"w{(i * 7 + k * k) % 97}"
    plain = [(i, " ".join(word(i, k) for k in range(60)), "en", 1) for i in range(40)]
    odd = [(None, None, None, 2), (None, "no id here", "en", 2), (100, None, "en", 2), (101, "", None, 2), (3, "another text under a known id that is not like it", "en", 2), plain[5], plain[5], (102, "long " * 50_000, "en", 2)]
    df = spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, _id int").withColumns({"node": F.lit(1), "_maybe": F.lit("m"), "h": F.lit(0.5), "spans": F.lit(7)})
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8"), (None, "no id here"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda d: sorted(map(repr, d.collect()))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        got = out.collect()
        assert stage(spark, df.limit(0), str(tmp_path)).collect() == []
        if name == "tokens":
            assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in df.collect())
            continue
        assert out.columns == df.columns and set(map(repr, got)) <= set(rows(df))
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i in [*range(40), 3, 100, 101, 102, None, None])
        if name in ("decontamination", "secret_scan"):
            assert sorted(map(repr, got)) == rows(df)
