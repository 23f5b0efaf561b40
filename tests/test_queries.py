"""Every registered query with SQL gives what an independent engine gives on the smallest scale."""

import duckdb
import pytest

from quillgraph import queries
from quillgraph.sources import facts

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in queries.QUERIES if n in queries.ORACLE)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in facts.BASE:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    want = sorted(repr([plain(v) for v in r]) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want


def test_queries_without_sql_are_the_known_ones():
    assert sorted(set(queries.QUERIES) - set(queries.ORACLE)) == ["greedy_clusters"]


def test_wrapped_detect_has_a_row_for_every_document(spark, tmp_path):
    texts = ["é wrapped", "wrappedé", "éwrapped", "ÉDEADBEEF1é", "xdeadbeef1", "é and unwrapped", "deadbee"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.wrapped for r in queries.QUERIES["wrapped_detect"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(c.sql(queries.ORACLE["wrapped_detect"]).fetchall()) == dict(enumerate([True, True, True, True, False, False, False]))


def test_queries_take_all_rows(spark):
    n = lambda name: queries.QUERIES[name](spark, SF).count()
    assert n("sql_unpivot") == 2 * facts.load(spark, SF, "lineitem").count()
    assert n("named_query") == facts.load(spark, SF, "call").filter("line BETWEEN 1 AND 15").count()
    assert queries.QUERIES["subtree_tables"](spark, SF).filter("root = 'C1'").count() == facts.load(spark, SF, "orders").filter("o_custkey = 1").select("o_orderpriority").distinct().count()
