import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from quillgraph.llm import token_count as T

PATH = P.path("piece_bpe_32k.model")
# The library needs an unknown piece and the bytes; the texts of the tests never spell them.
LIBRARY = Tokenizer(Unigram([("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *T.vocabulary(PATH)], unk_id=0, byte_fallback=True))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aehinorstTX0é漢😀​ß_-.▁", max_size=30))
def test_counts_are_those_of_the_library(word):
    assert T.loaded(PATH).count(T.MARK + word)[0] == len(LIBRARY.encode(T.MARK + word).ids)


def test_ties_go_to_the_longer_last_piece():
    table = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -1.0), ("bc", -2.0)]
    lib = Tokenizer(Unigram(table, unk_id=0, byte_fallback=False))
    for w in ("ab", "abc", "aabbc", "bca"):
        assert T.Pieces(table).count(w)[0] == len(lib.encode(w).ids)


def test_texts(spark):
    texts = ["", None, "Hello world", " \n\t", "x" * 4000, "the " * 9000, "漢字 éa", "same", "same"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "null id", 3)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r.doc_id: r for r in T.count_tokens(df, PATH).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(len(LIBRARY.encode(T.MARK + w).ids) for w in words))
    assert T.count_tokens(df.limit(0), PATH).collect() == []


def test_reserved_pieces_are_characters_in_a_text():
    names = {p for p, _ in T.vocabulary(PATH)}
    assert not names & {"<unk>", "<s>", "</s>", "<0x41>"}
    plain = Tokenizer(Unigram([("\ue000", 0.0), *T.vocabulary(PATH)], unk_id=0, byte_fallback=False))
    for w in ("a<unk>b", "<s>", "x</s>", "<0x41><0x42>"):
        assert T.loaded(PATH).count(T.MARK + w)[0] == len(plain.encode(T.MARK + w).ids) > 1


def test_a_score_does_not_depend_on_the_texts_around(spark):
    text = "some words of a text, and more of them " * 50
    df = spark.createDataFrame([(i, text if i % 3 else "other " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    assert len({r.score for r in T.count_tokens(df, PATH).collect() if r.doc_id % 3}) == 1
