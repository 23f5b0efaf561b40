"""Sources and sinks around fact tables: source files, archives, line-wise JSON, chunks, TSV caches, versions, configuration.

Paths are whatever Spark reads. Writers give tables; readers take explicit schemas.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of source files.
SUFFIXES = ("sql", "pks", "pkb", "prc", "fnc", "trg", "vw", "mv", "seq")


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text`` of all source files below a folder: UTF-8 without its mark, else ISO-8859-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % ",".join(SUFFIXES)).load(folder)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", F.regexp_replace(text, "^\ufeff", "").alias("text"))


def joined_source(lines: DataFrame) -> DataFrame:
    """``lines(owner, name, type, line, text)`` to one text for each object; of several owners the first by name."""
    first = lines.groupBy("name", "type").agg(F.min("owner").alias("owner"))
    own = lines.join(first, ["name", "type", "owner"], "left_semi")
    g = own.groupBy("owner", "name", "type").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return g.select("owner", "name", "type", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def through_cache(wanted: DataFrame, cache: DataFrame, fetch, *keys: str) -> DataFrame:
    """Rows of a cache, and ``fetch`` of the keys that it lacks."""
    keys = list(keys)
    return cache.join(wanted, keys, "left_semi").unionByName(fetch(wanted.join(cache.select(*keys), keys, "left_anti")))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``archive, entry, size, content`` of the entries of JAR and WAR files, nested archives included, a row at a time."""

    def entries(name: str, data: bytes, prefix: str) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for e in z.infolist():
                if e.is_dir():
                    continue
                body = z.read(e)
                if e.filename.endswith((".jar", ".war")):
                    yield from entries(name, body, f"{prefix}{e.filename}!/")
                else:
                    yield name, prefix + e.filename, len(body), body

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                for row in entries(path.rsplit("/", 1)[-1], bytes(content), ""):
                    yield pd.DataFrame([row], columns=["archive", "entry", "size", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jar,war}").load(folder).select("path", "content")
    return files.mapInPandas(run, "archive string, entry string, size long, content binary")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-wise JSON with a schema; a line that is none gives nulls."""
    return spark.read.schema(schema).json(path)


def flattened_config(files: DataFrame) -> DataFrame:
    """``files(path, text)`` of ``.properties``, ``.yml`` and ``.json`` to ``path, key, value`` with dotted keys."""

    def yaml(text: str) -> Iterator[tuple[str, str]]:
        stack: list[tuple[int, str]] = []
        for raw in text.splitlines():
            line = raw.split(" #")[0].rstrip()
            if not line.strip() or line.lstrip().startswith(("#", "---", "- ")) or ":" not in line:
                continue
            depth = len(line) - len(line.lstrip())
            key, _, value = line.strip().partition(":")
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, key.strip("'\"")))
            if value.strip():
                yield ".".join(k for _, k in stack), value.strip().strip("'\"")

    def nested(prefix: str, v) -> Iterator[tuple[str, str]]:
        if isinstance(v, dict):
            for k, x in v.items():
                yield from nested(f"{prefix}.{k}" if prefix else k, x)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from nested(f"{prefix}[{i}]", x)
        elif v is not None:
            yield prefix, str(v)

    def pairs(path: str, text: str) -> Iterator[tuple[str, str]]:
        if path.endswith(".json"):
            yield from nested("", json.loads(text))
        elif path.endswith((".yml", ".yaml")):
            yield from yaml(text)
        else:
            for line in text.splitlines():
                if line.strip() and not line.lstrip().startswith(("#", "!")) and "=" in line:
                    k, _, v = line.partition("=")
                    yield k.strip(), v.strip()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, k, v) for p, t in zip(b["path"], b["text"], strict=True) for k, v in pairs(p, t or "")], columns=["path", "key", "value"])

    return files.select("path", "text").mapInPandas(run, "path string, key string, value string")


def write_chunk(df: DataFrame, folder: str, chunk: int) -> None:
    """A chunk of a crawl; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{folder}/chunk={chunk}")


def merge_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks, with their number."""
    return spark.read.option("basePath", folder).parquet(folder)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def capped(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Arrays cut to their caps, with the full number beside them."""
    return df.withColumns({f"{c}_total": F.size(c) for c in caps} | {c: F.slice(c, 1, n) for c, n in caps.items()})


def row_at(df: DataFrame, index: int, column: str = "idx") -> DataFrame:
    """The row that a stored index names; the filter reaches the scan."""
    return df.filter(F.col(column) == index)


def listing(headers: DataFrame) -> DataFrame:
    """Headers, newest first, undated last."""
    return headers.orderBy(F.col("analyzed_at").desc_nulls_last(), "name")


def slice_of(df: DataFrame, heavy: list[str], fields: list[str] | None = None) -> DataFrame:
    """Header columns alone, or with chosen heavy ones: what is not chosen is not read."""
    return df.select(*[c for c in df.columns if c not in heavy or c in (fields or [])])


class Versions:
    """Versions of a table in one folder: the latest is read, the one before can be brought back."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs, self._path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def numbers(self) -> list[int]:
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def write(self, df: DataFrame) -> int:
        v = (self.numbers() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v={v}")
        return v

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v={version or self.numbers()[-1]}")

    def revert(self) -> int:
        """Drop the latest version."""
        *rest, last = self.numbers()
        self._fs.delete(self._path(f"{self.folder}/v={last}"), True)
        return rest[-1] if rest else 0


def jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 8, **options: str) -> DataFrame:
    """A dictionary table of a database, read in parallel by ranges of a column; filters reach the database."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        r = r.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return r.load()


def decoded(content: Column) -> Column:
    """Bytes as text, by the rule of ``read_sources``."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
