"""Operators on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph import queries
from quillgraph.functions import classify, sqltext
from quillgraph.operators import dispatch, graph, pack, resolve, similar
from quillgraph.plans import dialect
from quillgraph.sources import facts
from quillgraph.streaming import windows


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def reach(pairs):
    out = set(pairs)
    while True:
        new = {(a, d) for a, b in out for c, d in pairs if b == c} - out
        if not new:
            return out
        out |= new


SHAPES = {
    "loop": [("a", "a")], "two": [("a", "b"), ("b", "a")], "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")],
    "tail": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parts": [("a", "b"), ("x", "y")],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_closure_cycles_and_components(spark, shape):
    pairs = SHAPES[shape]
    want = reach(set(pairs))
    e = edges(spark, pairs)
    assert {(r.src, r.dst) for r in graph.closure(e).collect()} == want
    assert {r.node for r in graph.in_cycle(e).collect()} == {a for a, b in want if a == b}
    comp = {r.node: r.comp for r in graph.strong_components(e).collect()}
    assert all((comp[a] == comp[b]) == (a == b or ((a, b) in want and (b, a) in want)) for a in comp for b in comp)
    assert {(r.src, r.dst): r.back for r in graph.edges_in_components(e).collect()} == {(a, b): (b, a) in want for a, b in pairs}


def test_tree_limits(spark):
    star = edges(spark, [("r", f"c{i:02}") for i in range(40)])
    root = spark.createDataFrame([("r",)], "root string")
    assert graph.path_tree(star, root, max_children=30).count() == 31
    assert graph.path_tree(star, root, max_nodes=10).count() == 10
    chain = edges(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)])
    first = spark.createDataFrame([("n00",)], "root string")
    assert graph.path_tree(chain, first, max_depth=5).agg(F.max("depth")).first()[0] == 5
    stats = graph.tree_stats(graph.path_tree(edges(spark, SHAPES["two"]), spark.createDataFrame([("a",)], "root string"))).first()
    assert (stats.n_nodes, stats.n_edges, stats.max_depth) == (2, 2, 1)


def test_propagation_stops_at_evidence(spark):
    e = edges(spark, [("r", "m"), ("m", "l"), ("r", "q"), ("q", "z")])
    ev = spark.createDataFrame([("l", "READ"), ("q", "COUNT"), ("z", "WRITE")], "node string, op string")
    assert {r.node: r.op for r in graph.propagate(e, ev).collect()} == {"l": "READ", "m": "READ", "q": "COUNT", "z": "WRITE", "r": "READ"}


def test_empty_graph(spark):
    assert graph.closure(edges(spark, [])).collect() == []


def test_greedy_clusters_against_a_loop(spark):
    r = random.Random(3)
    ids = [f"e{i:02}" for i in range(30)]
    size, owner = {i: r.randrange(1, 9) for i in ids}, {i: r.choice("xyz") for i in ids}
    score = {(a, b): round(r.random() * 0.5, 3) for a in ids for b in ids if a < b and r.random() < 0.4}
    got = similar.greedy_clusters(spark.createDataFrame([(0, a, b, s) for (a, b), s in score.items()], "part int, a string, b string, score double"), spark.createDataFrame([(0, i, size[i], owner[i]) for i in ids], "part int, id string, size int, owner string"), most=5).collect()
    free, want, n = sorted(ids, key=lambda i: (-size[i], i)), {}, 0
    while free:
        seed = free.pop(0)
        near = sorted(((score.get((min(seed, x), max(seed, x)), 0.0) + 0.3 * (owner[x] == owner[seed]), x) for x in free), key=lambda t: (-t[0], t[1]))
        for x in [seed, *[x for s, x in near if s >= 0.15][:4]]:
            want[x] = n
            if x in free:
                free.remove(x)
        n += 1
    assert {g.id: g.cluster for g in got} == want


def test_narrow_against_a_loop_over_all_implementations(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("aAbB.É") for _ in range(r.randrange(n)))
    maybe = lambda v: v if r.random() < 0.85 else None
    impls = [(r.choice("IJ") if r.random() < 0.8 else f"L{i}", maybe(f"p.{word(5)}{i % 17}"), maybe(word(6)), r.random() < 0.1, r.randrange(9)) for i in range(40)]
    beans = [(f"a{i}", r.choice(impls)[1]) for i in range(8)] + [("aB", impls[0][1])]
    calls = [(k, maybe(r.choice(["I", "J", *(f"L{i}" for i in range(40))])), maybe(r.choice([word(4), word(9), f"a{k % 8}"])), maybe(r.choice([word(4), f"a{k % 8}"]))) for k in range(700)]
    by_bean = [i for i in impls if i[1] and i[2] and "." not in i[2] and not i[3]][:5]
    beans += [(f"Z{n}z", i[1]) for n, i in enumerate(by_bean)]
    calls += [(1000 + n, i[0], f"Z{n}z", None) for n, i in enumerate(by_bean)]
    end = lambda name, tail: name is not None and name.endswith("." + tail)

    def rule(iface, field, q, i):
        _, impl, simple, primary, _ = i
        low, named = simple if simple is None else simple.lower(), dict(beans)
        if field is not None and q is not None:
            if (simple is not None and q == simple[:1].lower() + simple[1:]) or end(impl, q):
                return 1
            if impl is not None and named.get(q) == impl:
                return 2
            if (low is not None and q.lower() in low) or end(impl and impl.lower(), q.lower()):
                return 3
        if field is not None:
            if len(field) > 3 and low is not None and (field.lower() in low or low in field.lower()):
                return 4
            if impl is not None and named.get(field) == impl:
                return 5
        return 6 if primary and sum(x[3] for x in impls if x[0] == iface) == 1 else None

    want = {}
    for k, iface, field, q in calls:
        fits = sorted((n, i[4], i[1] or "", i[1] is not None) for i in impls if i[0] == iface and (n := rule(iface, field, q, i)))
        want[k] = (fits[0][2] if fits[0][3] else None, fits[0][0]) if fits else (None, None)
    df = dispatch.narrow(
        spark.createDataFrame(calls, "k int, iface string, field string, qualifier string"), spark.createDataFrame(impls, "iface string, impl string, simple string, primary boolean, ord int"), spark.createDataFrame(beans, "name string, bean string")
    )
    assert {x.k: (x.impl, x.rule) for x in df.collect()} == want
    assert {n for _, n in want.values()} == {None, 1, 2, 3, 4, 5, 6}
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(" not in plan and "endswith(" not in plan


@pytest.mark.parametrize("block", [1024, 7])
def test_crowded_fingerprints_give_every_pair_without_a_join_of_them(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    r = random.Random(block)
    ids = [f"{c}{i}" for i in range(30) for c in ("e", "é", "😀")] + [""]
    sets = {i: r.sample(range(20), r.randrange(1, 20)) for i in ids} | {"lone": ["own"]}
    weight = {d: 0.1 + r.random() for d in range(20)} | {"own": 0.3}
    f = spark.createDataFrame([(i, f"d{d}") for i in sets for d in sets[i]] + [(None, "d1"), ("e1", None)], "id string, dep string")
    weights = spark.createDataFrame([(f"d{d}", w) for d, w in weight.items()], "dep string, weight double")
    total = lambda s: sum(weight[d] for d in s)
    want = {(a, b): total({*sets[a]} & {*sets[b]}) / total({*sets[a]} | {*sets[b]}) for a in sets for b in sets if a.encode() < b.encode() and {*sets[a]} & {*sets[b]}}
    df = similar.weighted_jaccard(f, weights)
    got = {(x.a, x.b): x.score for x in df.collect()}
    assert df.count() == len(got) and got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 6e-7 and got[p] == round(got[p], 6) for p in want)
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [1024, 5])
def test_cohesion_of_crowded_clusters_meets_sets_and_not_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    r = random.Random(block)
    ids = [f"e{i:02}" for i in range(60)]
    sets = {i: r.sample(range(9), r.randrange(2, 9)) for i in ids}
    sets |= {i: sets["e03"] for i in ids[:45:3]}  # copies, in one cluster only
    cluster = {i: k % 3 for k, i in enumerate(ids)} | {"lone": 7, "bare": 8, "none": 8}
    sets["lone"] = [1]
    weight = [0.1 + r.random() for _ in range(9)]
    total = lambda s: sum(weight[d] for d in s)
    pairs = [(a, b) for a in cluster for b in cluster if a < b and cluster[a] == cluster[b]]
    score = {p: total({*sets.get(p[0], [])} & {*sets.get(p[1], [])}) / (total({*sets.get(p[0], [])} | {*sets.get(p[1], [])}) or 1) for p in pairs}
    mean = lambda v: round(sum(round(x, 6) for x in v) / len(v), 6) if v else 1.0
    want = {c: (list(cluster.values()).count(c), mean([s for p, s in score.items() if cluster[p[0]] == c])) for c in cluster.values()}
    f = spark.createDataFrame([(i, f"d{d}") for i in sets for d in sets[i]], "id string, dep string")
    df = similar.cohesion(spark.createDataFrame(list(cluster.items()), "id string, cluster int"), f, spark.createDataFrame([(f"d{d}", w) for d, w in enumerate(weight)], "dep string, weight double"))
    assert {x.cluster: (x.n, x.cohesion) for x in df.collect()} == want
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [1, 4])
def test_stripes_of_blocks_give_every_pair_from_few_copies_of_a_block(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    r = random.Random(block)
    kinds = [r.sample(range(8), r.randrange(2, 8)) for _ in range(40)]
    sets = {f"{c}{i}": r.choice(kinds) for i in range(100) for c in ("e", "é", "😀")}
    f = spark.createDataFrame([(i, f"d{d}") for i in sets for d in sets[i]] + [(None, "d1"), (None, "d2"), ("lone", "unweighted")], "id string, dep string")
    weights = spark.createDataFrame([(f"d{d}", 0.5 + d) for d in range(8)], "dep string, weight double")
    total = lambda s: sum(0.5 + d for d in s)
    want = {(a, b): round(total({*sets[a]} & {*sets[b]}) / total({*sets[a]} | {*sets[b]}), 6) for a in sets for b in sets if a.encode() < b.encode() and {*sets[a]} & {*sets[b]}}
    df = similar.weighted_jaccard(f, weights)
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == len(want) and all(abs(x.score - want[x.a, x.b]) < 2e-6 for x in rows)
    blocks = -(-len(sets) // block)
    assert len({x.task for x in rows}) < blocks * (blocks + 1) / 2 / 8


def test_cohesion_where_blocks_have_no_rows(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 1)
    sets = {f"e{i:02}": [d for d in range(6) if i >> d & 1] + [9] for i in range(40)}
    f = spark.createDataFrame([(i, f"d{d}") for i in sets for d in sets[i]], "id string, dep string")
    weights = f.select("dep").distinct().withColumn("weight", F.lit(1.0))
    want = [round(len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}), 6) for a in sets for b in sets if a < b]
    got = similar.cohesion(f.select("id", F.lit(3).alias("cluster")).distinct(), f, weights).collect()
    assert [(x.cluster, x.n, x.cohesion) for x in got] == [(3, 40, round(sum(want) / len(want), 6))]


def test_greedy_clusters_make_no_table_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "weighted_jaccard", None)
    assert queries.QUERIES["greedy_clusters"](spark, "/root/testdata/sf0.001").count() == facts.load(spark, "/root/testdata/sf0.001", "fingerprint").select("id").distinct().count()


@pytest.mark.parametrize("n_deps", [12, 400])
def test_greedy_fingerprints_like_clusters_of_all_scores(spark, n_deps):
    r = random.Random(n_deps)
    ids = [f"e{i:03}" for i in range(160)]
    sets = {i: frozenset(r.sample(range(n_deps), r.randrange(0, 9))) for i in ids}
    sets |= {i: sets["e007"] for i in ids[100:140]}  # more copies than a cluster takes
    f = spark.createDataFrame([(i, f"d{d}") for i in ids for d in sets[i]], "id string, dep string")
    weights = f.groupBy("dep").agg(F.round(F.rand(1) + 0.1, 3).alias("weight")).localCheckpoint()
    for part in (0, 1):
        items = spark.createDataFrame([(k, i, r.randrange(1, 6), r.choice("xy")) for k in range(part + 1) for i in ids[k * 100 :]], "part int, id string, size int, owner string").filter(F.col("part") == part)
        scores = similar.weighted_jaccard(f.join(items, "id", "left_semi"), weights).withColumn("part", F.lit(part))
        got = similar.greedy_fingerprints(f, weights, items, most=7).collect()
        assert sorted(got) == sorted(similar.greedy_clusters(scores, items, most=7).collect())
        assert len(got) == items.count()


def test_bin_pack_and_purge(spark):
    seq = spark.createDataFrame([("k", i, s) for i, s in enumerate([10, 10, 30, 5, 5, 5, 11])], "label string, ord long, size long")
    assert [r.bin for r in pack.bin_pack(seq, 20, "label").orderBy("ord").collect()] == [0, 0, 1, 2, 2, 2, 3]
    assert sorted(r.ord for r in pack.history_purge(seq, 26, "label").collect()) == [3, 4, 5, 6]


def test_pick_and_suffixes(spark):
    df = spark.createDataFrame([("k", 2, "a"), ("k", 1, "b"), ("k", 1, "c")], "k string, rule int, v string")
    assert resolve.pick_first(df, ["k"], "rule", "v").first().v == "b"
    assert {r.v for r in resolve.pick_rank(df, ["k"], "rule").collect()} == {"b", "c"}
    assert spark.range(1).select(resolve.suffixes(F.lit("a.b.c"))).first()[0] == ["a.b.c", "b.c", "c"]


def test_dialect(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 50), (3, "c", 5)], "id int, v string, n int")
    s = spark.createDataFrame([(2, "x", 1), (3, "y", 1), (9, "z", 1)], "id int, v string, n int")
    got = sorted(map(tuple, dialect.merge(t, s, "id", {"v": F.col("s.v")}, delete=F.col("t.n") > 9).collect()))
    assert got == [(1, "a", 5), (3, "y", 5), (9, "z", 1)]
    assert dialect.rewrite("SELECT 'MINUS' FROM a MINUS SELECT x FROM DUAL") == "SELECT 'MINUS' FROM a EXCEPT SELECT x "
    assert spark.sql(dialect.rewrite("SELECT k FROM VALUES (1), (2), (3) t(k) ORDER BY k OFFSET 1 ROWS FETCH FIRST 1 ROWS ONLY")).first().k == 2
    arrays = spark.sql("SELECT array(1, 1, 2, 3) AS a, array(1, 2, 2) AS b").select(dialect.multiset_except(F.col("a"), F.col("b")), dialect.multiset_intersect(F.col("a"), F.col("b"))).first()
    assert list(arrays) == [[1, 3], [1, 2]]


def test_text_and_classes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(sqltext.tables(F.lit("select * from a.bb join cc on 1=1 where x in (select y from dual)"))) == ["A.BB", "CC"]
    assert one(sqltext.tables(F.lit("select * from a.b"))) == []  # the last part of a name has two characters or more
    assert one(sqltext.literals(F.lit("'it''s' || x || 'b'"))) == ["it's", "b"]
    assert one(classify.wrapped(F.lit("procedure p wrapped a000000"))) and not one(classify.wrapped(F.lit("procedure p is begin")))
    assert one(classify.wrapped(F.lit("x := 12345678;")))  # known: any number of eight digits counts


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    e.repartition(3).write.parquet(str(tmp_path / "in/x"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    out = windows.run_once(spark, str(tmp_path / "in/x"), schema, lambda s: windows.windowed(s, "1 hour", late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    batch = {(r.start, r.event_type): (r.n, r.total) for r in windows.windowed(e, "1 hour", late=None).collect()}
    got = {(r.start, r.event_type): (r.n, r.total) for r in out.collect()}
    last = max(start for start, _ in batch)  # the watermark stays at the newest event, so that the last window is open
    assert got == {k: v for k, v in batch.items() if k[0] < last}


def test_a_cycle_longer_than_fifty_is_found(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 52) for i in range(52)], "src int, dst int").coalesce(1)
    assert graph.in_cycle(edges).count() == 52


def test_names_that_statements_hold(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for text, tables, procs in (
        ("BEGIN UPDATE t1 SET a = 1; END; BEGIN SELECT 1", ["T1"], []), ("TRUNCATE foo", ["FOO"], []), ("truncate table a.b.foo", ["A.B.FOO"], []),
        ("merge into a1 using b1 on (1 = 1)", ["A1"], []), ("delete from unique where 1 = 1", [], []), ("select a into v from x", [], []), ("{? = call pk.fn(?)}", [], ["PK.FN"]), ("exec next", [], []), (None, None, None),
    ):
        assert one(sqltext.tables(F.lit(text).cast("string"))) == tables and one(sqltext.procedures(F.lit(text).cast("string"))) == procs


def test_operations_of_method_names(spark):
    names = {"incrementCounter": "UPDATE", "facetBy": "AGGREGATE", "scrollAll": "READ", "bulkWriteAll": "WRITE", "unwindX": "AGGREGATE", "watchIt": "READ", "mapReduceX": "AGGREGATE", "aggregation": "AGGREGATE", "addListener": None, "doWork": None, "setName": "UPDATE", None: None}
    df = spark.createDataFrame([(n, w) for n, w in names.items()], "n string, w string")
    assert all(r.op == r.w for r in df.select("w", classify.op_from_name(F.col("n")).alias("op")).collect())
    roles = df.filter("n = 'setName'").select(*[classify.op_from_name(F.col("n"), F.lit(r).cast("string")).alias(str(r)) for r in ("ENTITY", "OTHER", "SERVICE", None)])
    assert tuple(roles.first()) == (None, None, "UPDATE", None)


def test_objects_and_bodies_in_text(spark):
    texts = {'r {"a":{"b":1},"k":5} x': '{"a":{"b":1},"k":5}', " {open": "{open", "no": None, "} {x": None, None: None, 'a\n```json\n{"q": 1}\n```': '{"q": 1}'}
    df = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, w string")
    assert all(r.got == r.w for r in df.select("w", sqltext.json_object("t").alias("got")).collect())
    unit = "PROCEDURE a IS BEGIN BEGIN x; END; END; FUNCTION ab RETURN n IS BEGIN y; END ab; PROCEDURE c IS"
    rows = spark.createDataFrame([(unit, n) for n in ("a", "AB", "c", "d", None)], "s string, n string")
    assert [r[0] for r in rows.coalesce(1).select(sqltext.subprogram_source("s", "n")).collect()] == ["PROCEDURE a IS BEGIN BEGIN x; END; END;", "FUNCTION ab RETURN n IS BEGIN y; END ab;", None, None, None]


def test_search_has_no_silent_depth(spark):
    chain = edges(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(24)]).coalesce(1)
    assert graph.bfs(chain, spark.createDataFrame([("n00",)], "root string")).agg(F.max("depth")).first()[0] == 24
    tail = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("z", "a")])
    assert {(r.src, r.dst) for r in graph.cyclic_core(tail).collect()} == {("a", "b"), ("b", "a")}
