import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import decontaminate as C


def words_of(text):
    import re

    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain(item, text):
    """Least edit distance to any passage, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(1, 4), max_size=14))
def test_distance(item, text):
    assert C.best_passage(item, text)[0] == plain(item, text)


def test_triples_needed_lose_nothing():
    r = random.Random(0)
    for n in range(C.SHORT + 1, 60):
        item = list(range(n))
        for _ in range(30):
            t = list(item)
            for _ in range(C.allowed(n)):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], [1000 + r.randrange(99)], [t[k], 2000]])
            tri = {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
            assert sum(tuple(item[i : i + 3]) in tri for i in range(n - 2)) >= C.needed(n)


def test_recall_and_no_false_report(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(r.randrange(12, 50)))) for i in range(25)] + [(90, "too short"), (91, None), (92, "w1"), (93, "w2 w3 w4 w5 w6"), (94, ""), (None, "an item without id is never searched at all")]
    docs, planted = [], set()
    for d in range(300):
        body = text(r.randrange(0, 120))
        if d % 3 == 0:
            i, t = items[r.randrange(25)]
            w = t.split()
            for _ in range(r.randrange(0, C.allowed(len(w)) + 1)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice(vocab)], [w[k].upper() + ",", r.choice(vocab)]])
            body = body[: len(body) // 2] + w + body[len(body) // 2 :]
        docs.append((d, " ".join(body), 1.0, "x"))
    docs += [(1000, None, 1.0, "x"), (1001, "", 1.0, "x"), (None, items[0][1], 1.0, "x"), (0, docs[0][1], 1.0, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, found double, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for k, (d, t, *_) in enumerate(docs):
        for i, it in items:
            n = len(words_of(it))
            if i is not None and n and plain(words_of(it), words_of(t)) <= C.allowed(n):
                want.add((d, i))
    rows = C.contaminated(df, bench).collect()
    got = {(x.doc_id, i) for x in rows for i in x.item_ids}
    assert len(rows) == len(docs) and got <= want and len(got) >= 0.95 * len(want) and len(want) > 80
    kept = C.clean(df, bench)
    assert kept.columns == df.columns and sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x.doc_id) for x in rows if not x.contaminated)


def test_exact_passages_are_always_found(spark):
    items = [(i, " ".join(f"k{i}x{j % 9}" for j in range(6 + i))) for i in range(20)]
    docs = [(i, f"Before, {t.upper()}! after that") for i, t in items]
    got = C.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(i in x.item_ids for x in got for i in [x.doc_id])


def test_slices_and_empty_tables(spark, monkeypatch):
    items = [(i, " ".join(f"k{i}x{j}" for j in range(9))) for i in range(12)]
    df, bench = spark.createDataFrame(items, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, C.contaminated(df, bench).collect()))
    monkeypatch.setattr(C, "SLICE_WORDS", 30)
    assert sorted(map(str, C.contaminated(df, bench).collect())) == one and C.clean(df, bench).count() == 0
    assert C.contaminated(df.limit(0), bench).collect() == []
    assert C.contaminated(df, bench.limit(0)).filter("contaminated").count() == 0


def test_items_of_a_few_words_against_all_passages():
    """Up to SHORT words no passage within the distance is lost, whatever is edited."""
    import pyarrow as pa

    from quillgraph.llm import text_kernel as K

    r = random.Random(6)
    word = lambda: r.choice("abcdefg")
    items = [(i, " ".join(word() for _ in range(1 + i % 5))) for i in range(40)]
    texts = [" ".join(word() for _ in range(r.randrange(0, 12))) for _ in range(300)]
    got = {(row, name): d for row, name, d, _ in sorted(C.Items(items).search(*C.plain_words(*K.buffer_of(pa.array(texts)))), key=lambda x: -x[2])}
    want = {(k, i): d for k, t in enumerate(texts) for i, it in items if (d := plain(it.split(), t.split())) <= C.allowed(len(it.split()))}
    assert got == want and len(want) > 300


def test_a_repeated_common_triple_takes_no_more_memory(monkeypatch):
    import pyarrow as pa

    from quillgraph.llm import text_kernel as K

    items = [(i, f"one two three four{i} five{i} six{i} seven{i}") for i in range(30)]
    texts = ["one two three " * 500 + items[7][1], "nothing of it", items[3][1]]
    args = C.plain_words(*K.buffer_of(pa.array(texts)))
    whole = sorted(C.Items(items).search(*args))
    monkeypatch.setattr(C, "EXPANDED", 700)
    assert sorted(C.Items(items).search(*args)) == whole and {(r, i) for r, i, *_ in whole} >= {(0, 7), (2, 3)}
