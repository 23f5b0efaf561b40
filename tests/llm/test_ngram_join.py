import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import ngram_join as J
from quillgraph.llm import text_kernel as K
from quillgraph.llm.components import components


def sets(text, words):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\x0b", " ").split(" ")
    w = [x for y in w for x in y.split("\n") if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < words else frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))


def brute(rows, words, percent):
    """Smallest id by plain closure over all pairs."""
    s = [(i, sets(t, words)) for i, t in rows]
    comp = {i: i for i, _ in s}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return {i: (len(a), find(i)) for i, a in s}


def texts():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(n)] for n in (1, 2, 3, 9, 10, 11, 12, 20, 40, 80, 150)]
    shared = [r.choice(vocab) for _ in range(30)]
    out = ["", None, " \n ", "a", "A", "a b", "a  B", "a b c"]
    for b in base:
        out += [" ".join(b), " ".join(b).upper(), " ".join(b + ["x"])]
        for _ in range(6):  # near copies with a few words changed
            c = list(b)
            for _ in range(max(1, len(c) // 60)):
                c[r.randrange(len(c))] = r.choice(vocab)
            out.append(" ".join(c))
    out += [" ".join(shared + [r.choice(vocab) for _ in range(n)]) for n in (2, 3, 5, 8, 30, 60) for _ in range(6)]
    return out


def test_join_against_all_pairs(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 0, "t") for i, t in rows], "doc_id long, text string, node int, token string").repartition(4)
    for words, percent in ((3, 90), (5, 80)):
        want = brute(rows, words, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df, words=words, percent=percent).collect()}
        assert got == want


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "q r s t"), (None, "lonely text here")]
    got = sorted(((r.doc_id, r.component_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (9, 9), (None, None)], key=str)
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_group_of_near_copies(spark):
    r = random.Random(1)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(400):
        c = list(base)
        c[r.randrange(120)] = f"u{i}"
        rows.append((i, " ".join(c)))
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: v[1] for i, v in brute(rows, 3, 90).items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=10), max_size=7), st.integers(1, 4), st.integers(0, 4))
def test_divide_skip_counts(lists, t, long):
    arrays = [np.unique(np.array(x, np.int64)) for x in lists]
    ids, seen = J.divide_skip(arrays, t, long)
    counts = {i: sum(i in x for x in arrays) for i in range(13)}
    assert dict(zip(ids.tolist(), seen.tolist(), strict=True)) == {i: c for i, c in counts.items() if c >= t}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (9, 10)] + [(i, i + 1) for i in range(20, 60)] + [(100, 100 + i) for i in range(1, 40)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 10: 9} | {i: 20 for i in range(20, 61)} | {i: 100 for i in range(100, 140)}
    assert got == want


def test_deduplicated_keeps_one_of_each_group(spark):
    df = spark.createDataFrame([(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (5, "other words are in this one", "z"), (1, "a b c d e f g", "y")], "doc_id long, text string, source string")
    got = J.deduplicated(df, words=5, percent=80)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 5]


def test_lists_of_a_pair_are_counted_together(spark):
    """In one list of the pair (a, b) most members are with a, in the other with b; both lists are needed for the link."""
    words = [f"w{i}" for i in range(40)]
    buf, offs = K.buffer_of(pa.array(words, pa.string()))
    h, _ = J.shingles(buf, offs, 1)
    w = [words[i] for i in np.argsort(h)]
    rare, a = w[:4], w[4:]
    b = rare + a
    sets = [a, [x for x in a if x != a[1]], b, [x for x in b if x != a[0]]]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "doc_id long, text string")
    assert [r.component_id for r in J.join(df, words=1, percent=90).collect()] == [0, 0, 0, 0]


def test_deduplicated_loses_no_text_where_an_id_repeats(spark):
    a, b, c = "a b c d e f g", "other words are in this one here", "and a third text of some length"
    rows = [(1, a, 1, "x"), (5, a, 2, "x"), (5, b, 3, "x"), (7, c, 4, "x"), (7, c, 4, "x"), (None, a, 5, "n"), (None, None, 6, "n"), (8, "", 7, "e"), (8, " \n", 8, "e"), (9, None, 9, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, _keep string").withColumnRenamed("_keep", "_maybe").repartition(3)
    for frame in (df, df.withColumnRenamed("_row", "_id").withColumnRenamed("_maybe", "_h")):
        out = J.deduplicated(frame, words=5, percent=80)
        got = out.collect()
        assert out.columns == frame.columns
        assert sorted(tuple(r)[:3] for r in got if r.doc_id) == [(1, a, 1), (5, b, 3), (7, c, 4), (8, "", 7), (8, " \n", 8), (9, None, 9)]
        assert sorted(r[2] for r in got if r.doc_id is None) == [5, 6]
    assert J.deduplicated(df.limit(0), words=5, percent=80).collect() == []


def test_repeated_rows_of_linked_texts(spark):
    base = [f"v{i}" for i in range(60)]
    near = [*base[:59], "other"]
    rows = [(3, " ".join(base))] * 20 + [(2, " ".join(near))] * 15 + [(4, " ".join(base)), (2, "unlike the others in each word")]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted([(3, 58, 2)] * 20 + [(2, 58, 2)] * 15 + [(4, 58, 2), (2, 4, 2)])


def test_long_lists_are_dealt(spark, monkeypatch):
    """With limits so low that most lists are long, and parts of lists small, the result is that of all pairs."""
    monkeypatch.setattr(J, "HEAVY", 2)
    monkeypatch.setattr(J, "LONG_SHARE", 1 << 40)
    monkeypatch.setattr(J, "PART", 3)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for words, percent in ((3, 90), (1, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df, words=words, percent=percent).collect()}
        assert got == brute(rows, words, percent)


def test_sets_that_share_a_signature(spark, monkeypatch):
    """Two 64-bit signatures tell sets apart: with a first one of two values, texts still go by their sets."""
    both = J.signatures
    monkeypatch.setattr(J, "signatures", lambda flat, cuts: (both(flat, cuts)[0] & 1, both(flat, cuts)[1]))
    rows = [(i, t) for i, t in enumerate(["a b c d e", "a b c d e", "f g h i j", "k l m n o", "k l m n o", "p q r s t u"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: (r.component_id, r.class_id) for r in J.join(df).collect()} == {0: (0, 0), 1: (0, 0), 2: (2, 2), 3: (3, 3), 4: (3, 3), 5: (5, 5)}


def test_a_very_long_text(spark):
    r = random.Random(8)
    long = " ".join(f"t{r.randrange(5000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "t1 t2 t3 t4")]
    assert {x.doc_id: x.component_id for x in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 3}


def test_components_of_hubs_and_chains(spark, monkeypatch):
    from quillgraph.llm import components as C

    monkeypatch.setattr(C, "HUBS", 5)
    r = random.Random(2)
    links = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(50)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(260)]
    comp = {x: x for p in links for x in p}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        comp[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {x.node: x.comp for x in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_told_by_a_bitmap(spark, monkeypatch):
    from quillgraph.llm import members as M

    rows = spark.range(3000).selectExpr("if(id = 7, null, id) AS k", "id AS v")
    gone = spark.range(0, 3000, 3).selectExpr("id AS k")
    for most in (29, 12):
        monkeypatch.setattr(M, "MOST_BITS", most)
        assert sorted(r.v for r in M.without(rows, ["k"], gone).collect()) == [i for i in range(3000) if i % 3 or i == 7]
        assert sorted(r.v for r in M.only(rows, ["k"], gone).collect()) == [i for i in range(0, 3000, 3)]
    assert M.without(rows, ["k"], gone.limit(0)).count() == 3000 and M.only(rows, ["k"], gone.limit(0)).count() == 0


def test_components_of_stars_take_no_round_and_a_chain_ends_with_its_last(spark, monkeypatch):
    from quillgraph.llm import components as C

    rounds, least = [], C._with_least
    monkeypatch.setattr(C, "_with_least", lambda links, n: rounds.append(n) or least(links, n))
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    got = lambda pairs: {r.node: r.comp for r in components(links(pairs)).collect()}
    assert got([(-5, k) for k in range(6)] + [(9, -7), (8, -7), (9, 9), (20, 21)]) == {-5: -5, **dict.fromkeys(range(6), -5), -7: -7, 8: -7, 9: -7, 20: 20, 21: 20}
    assert not rounds
    assert got([(0, 1), (1, 2), (2, 0)]) == {0: 0, 1: 0, 2: 0}
    assert len(rounds) == 2  # one round of two steps, none to see that nothing changes
