import io
import zipfile

from quillgraph.functions import plsql
from quillgraph.sources import facts, stores

UNIT = """CREATE OR REPLACE PACKAGE BODY pkg_a AS
  CURSOR c_emp IS SELECT id FROM hr.emp e WHERE e.dept = 3;
  PROCEDURE run_all(p NUMBER) IS
  BEGIN
    -- delete from nowhere
    WITH q AS (SELECT 1 x FROM base_t) SELECT x INTO v FROM q LEFT OUTER JOIN orders o ON o.k = q.x WHERE o.id IN (SELECT id FROM items);
    UPDATE emp SET a = pkg_b.f(1, g(2)) WHERE id = 1;
    INSERT INTO audit_log VALUES (audit_seq.NEXTVAL, 'from x');
    DELETE FROM tmp_t;
    MERGE INTO inv t USING dlv s ON (t.id = s.id) WHEN MATCHED THEN UPDATE SET t.q = 1;
    pkg_c.go;
    EXECUTE IMMEDIATE 'TRUNCATE TABLE z';
    COMMIT;
  EXCEPTION
    WHEN OTHERS THEN ROLLBACK;
  END;
END;"""


def test_plsql_facts(spark):
    rows = plsql.facts(spark.createDataFrame([("a.pkb", UNIT), ("b.sql", None)], "path string, text string")).collect()
    got = {(r.kind, r.name, r.op) for r in rows}
    assert {("table", "HR.EMP", "SELECT"), ("table", "BASE_T", "SELECT"), ("table", "ORDERS", "SELECT"), ("table", "ITEMS", "SELECT"), ("table", "EMP", "UPDATE"), ("table", "AUDIT_LOG", "INSERT"), ("table", "TMP_T", "DELETE"), ("table", "INV", "MERGE"), ("table", "DLV", "SELECT")} <= got
    assert not any(r.kind == "table" and r.name in ("Q", "NOWHERE", "V") for r in rows)
    assert {("subprogram", "RUN_ALL", "PROCEDURE"), ("unit", "PKG_A", "PACKAGE BODY"), ("join", "ORDERS", "LEFT OUTER"), ("cursor", "C_EMP", "DECLARE"), ("sequence", "AUDIT_SEQ", "NEXTVAL"), ("control", "", "COMMIT"), ("handler", "OTHERS", "")} <= got
    assert {(r.name, r.detail) for r in rows if r.kind == "call"} >= {("PKG_B.F", "2"), ("G", "1"), ("PKG_C.GO", "0")}
    assert next(r.detail for r in rows if r.name == "ITEMS") == "IN"


def test_files_archives_and_configuration(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.sql").write_bytes("\ufeffselect 'é'".encode())
    (tmp_path / "src/b.pkb").write_bytes("x := 'é';".encode("latin-1"))
    (tmp_path / "src/c.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in stores.read_sources(spark, str(tmp_path / "src")).collect()}
    assert got == {"a.sql": "select 'é'", "b.pkb": "x := 'é';"}
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("X.class", b"123")
    (tmp_path / "jars").mkdir()
    with zipfile.ZipFile(tmp_path / "jars/app.war", "w") as z:
        z.writestr("WEB-INF/lib/in.jar", inner.getvalue())
        z.writestr("app.yml", "a:\n  b: 1\n  c:\n    d: 'x'\n")
    rows = {r.entry: r.size for r in stores.read_archives(spark, str(tmp_path / "jars")).collect()}
    assert rows["WEB-INF/lib/in.jar!/X.class"] == 3
    conf = spark.createDataFrame([("a.yml", "a:\n  b: 1\n  c:\n    d: 'x' # why\n"), ("b.properties", "# no\nk = v=w\n"), ("c.json", '{"p": {"q": [1, {"r": true}]}}')], "path string, text string")
    assert {(r.key, r.value) for r in stores.flattened_config(conf).collect()} == {("a.b", "1"), ("a.c.d", "x"), ("k", "v=w"), ("p.q[0]", "1"), ("p.q[1].r", "True")}


def test_chunks_versions_and_slices(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2, 3]), (2, "b", [4])], "idx int, name string, heavy array<int>")
    for k in (0, 1, 1):
        stores.write_chunk(df, str(tmp_path / "chunks"), k)
    assert stores.merge_chunks(spark, str(tmp_path / "chunks")).count() == 4
    v = stores.Versions(spark, str(tmp_path / "v"))
    assert v.numbers() == [] and v.write(df) == 1 and v.write(df.limit(1)) == 2 and v.read().count() == 1 and v.read(1).count() == 2
    assert v.revert() == 1 and v.read().count() == 2
    assert stores.slice_of(df, ["heavy"]).columns == ["idx", "name"] and stores.row_at(df, 2).first().name == "b"
    assert [r.heavy for r in stores.capped(df, {"heavy": 2}).orderBy("idx").collect()] == [[1, 2], [4]]
    stores.write_tsv(df.select("idx", "name"), str(tmp_path / "t"))
    assert stores.read_tsv(spark, str(tmp_path / "t"), "idx int, name string").count() == 2
    lines = spark.createDataFrame([("B", "p", "T", 2, "y"), ("B", "p", "T", 1, "x"), ("C", "p", "T", 1, "z")], "owner string, name string, type string, line int, text string")
    assert [r.text for r in stores.joined_source(lines).collect()] == ["x\ny"]
    want, cache = df.select("idx"), df.filter("idx = 1")
    assert stores.through_cache(want, cache, lambda miss: miss.selectExpr("idx", "'new' AS name", "array(0) AS heavy"), "idx").filter("name = 'new'").first().idx == 2


def small_class() -> bytes:
    """class a/B extends java/lang/Object implements a/I { void m() { this.n(); } }, put together by hand."""
    import struct

    pool, index = [], {}

    def utf(s):
        return add(b"\x01" + struct.pack(">H", len(s)) + s.encode())

    def add(raw):
        if raw not in index:
            pool.append(raw)
            index[raw] = len(pool)
        return index[raw]

    def cls(s):
        return add(b"\x07" + struct.pack(">H", utf(s)))

    this, parent, iface = cls("a/B"), cls("java/lang/Object"), cls("a/I")
    ref = add(b"\x0a" + struct.pack(">HH", this, add(b"\x0c" + struct.pack(">HH", utf("n"), utf("()V")))))
    add(b"\x05" + struct.pack(">q", 7))
    pool.append(None)
    code = bytes([42, 182]) + struct.pack(">H", ref) + bytes([177])
    body = struct.pack(">HHI", 1, 1, len(code)) + code + struct.pack(">HH", 0, 0)
    method = struct.pack(">HHHH", 1, utf("m"), utf("()V"), 1) + struct.pack(">HI", utf("Code"), len(body)) + body
    note = struct.pack(">HHH", 1, utf("La/Svc;"), 0)
    tail = struct.pack(">HHHHHHH", 0x21, this, parent, 1, iface, 0, 1) + method + struct.pack(">H", 1) + struct.pack(">HI", utf("RuntimeVisibleAnnotations"), len(note)) + note
    return struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(pool) + 1) + b"".join(p for p in pool if p) + tail


def test_class_files(spark):
    from quillgraph.sources import classfiles

    df = spark.createDataFrame([("x.jar", "a/B.class", bytearray(small_class())), ("x.jar", "bad.class", bytearray(b"no")), ("x.jar", "t.txt", bytearray(b""))], "archive string, entry string, content binary")
    rows = classfiles.facts(df).collect()
    assert {(r["class"], r.kind, r.name, r.target) for r in rows} == {("a.B", "class", "a.B", ""), ("a.B", "method", "m", ""), ("a.B", "call", "m()V", "a.B#n()V"), ("bad.class", "error", "no class file", "")}
    assert next((r.super, r.interfaces, r.annotations) for r in rows if r.kind == "class") == ("java.lang.Object", ["a.I"], ["a.Svc"])


def test_views_hold_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    n = {t: facts.load(spark, sf, t).count() for t in ("nation", "customer", "orders")}
    assert facts.load(spark, sf, "edge_dag").count() == sum(n.values())
    a = facts.load(spark, sf, "access")
    b = a.selectExpr("proc AS p", "tbl AS t", "line AS l").distinct()
    assert facts.load(spark, sf, "join_use").count() == a.join(b, (a["proc"] == b["p"]) & (a["line"] < b["l"])).count()
