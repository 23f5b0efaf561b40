"""Fingerprints, budgets and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pack
from ..registry import query


@query("fingerprint", "SELECT id, count(*) AS n, array_to_string(list_sort(list(dep)), ',') AS deps FROM {fingerprint} GROUP BY id")
def _(get):
    return get("fingerprint").groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("dep")), ",").alias("deps"))


@query("chunk_plan", """SELECT source, chars, nodes, CASE WHEN chars <= 50000 AND nodes <= 40 THEN 'WHOLE' ELSE 'SPLIT' END AS plan,
    CASE WHEN chars <= 50000 AND nodes <= 40 THEN 1 ELSE CAST(greatest(ceil(chars / 50000), ceil(nodes / 40)) AS BIGINT) END AS parts FROM (SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS nodes FROM documents GROUP BY source)""")
def _(get):
    sizes = get("documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("nodes"))
    return pack.chunk_plan(sizes, 50_000, 40)


@query("chunk_dedup", "SELECT ord, label, size FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, ord) AS r FROM {size_seq}) WHERE r = 1")
def _(get):
    return pack.chunk_dedup(get("size_seq"))


@query("bin_pack", """WITH RECURSIVE s AS (SELECT label, ord, size, row_number() OVER (PARTITION BY label ORDER BY ord) AS n FROM {size_seq}),
    b(label, n, ord, bin, used) AS (SELECT label, n, ord, 0, size FROM s WHERE n = 1 UNION ALL SELECT s.label, s.n, s.ord, CASE WHEN b.used > 0 AND b.used + s.size > 25000 THEN b.bin + 1 ELSE b.bin END,
    CASE WHEN b.used > 0 AND b.used + s.size > 25000 THEN s.size ELSE b.used + s.size END FROM b JOIN s ON s.label = b.label AND s.n = b.n + 1) SELECT label, ord, CAST(bin AS BIGINT) AS bin FROM b""")
def _(get):
    return pack.bin_pack(get("size_seq"), 25_000, "label")


@query("history_purge", "SELECT label, ord, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(size) OVER (PARTITION BY label ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS running FROM {size_seq}) WHERE running <= 60000")
def _(get):
    return pack.history_purge(get("size_seq"), 60_000, "label").select("label", "ord", "running")


@query("paged_topk", "SELECT id, loc FROM {endpoint} ORDER BY loc DESC, id LIMIT 25 OFFSET 50")
def _(get):
    return pack.page(get("endpoint").select("id", "loc"), 3, 25, F.desc("loc"), "id")


@query("endpoint_limit", "SELECT id, controller FROM {endpoint} ORDER BY id LIMIT 40")
def _(get):
    return pack.page(get("endpoint").select("id", "controller"), 1, 40, "id")


@query("cap_arrays", "SELECT endpoint, array_to_string(list_sort(list(DISTINCT collection))[1:5], ',') AS first_five FROM {usage} GROUP BY endpoint")
def _(get):
    return get("usage").groupBy("endpoint").agg(F.array_join(F.slice(F.sort_array(F.collect_set("collection")), 1, 5), ",").alias("first_five"))
