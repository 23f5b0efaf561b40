"""Extraction from SQL text and literals, as columns over regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NAME = r"([A-Za-z_][\w$#]*(?:\.[A-Za-z_][\w$#]*)*)"
# Words after which a table or procedure name stands, and words that are no name.
BEFORE_TABLE = (r"\bFROM", r"\bJOIN", r"\bINSERT\s+INTO", r"\bUPDATE", r"\bDELETE\s+FROM", r"\bMERGE\s+INTO", r"\bTRUNCATE(?:\s+TABLE)?")
BEFORE_PROCEDURE = (r"\bCALL", r"\bEXEC(?:UTE)?", r"\bBEGIN")
STOP_WORDS = (
    "SELECT", "FROM", "WHERE", "AND", "OR", "NOT", "IN", "ON", "AS", "SET", "VALUES", "INTO", "JOIN", "INNER", "OUTER", "LEFT", "RIGHT", "CROSS", "FULL", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET",
    "UNION", "ALL", "DISTINCT", "EXISTS", "BETWEEN", "LIKE", "IS", "NULL", "TRUE", "FALSE", "CASE", "WHEN", "THEN", "ELSE", "END", "BEGIN", "CALL", "EXEC", "EXECUTE",
    "CREATE", "ALTER", "DROP", "TABLE", "INDEX", "VIEW", "SCHEMA", "INSERT", "UPDATE", "DELETE", "MERGE", "TRUNCATE", "WITH", "FETCH", "NEXT", "ROWS", "ONLY", "DUAL", "COUNT", "SUM", "AVG",
    "MIN", "MAX", "ASC", "DESC", "CASCADE", "RESTRICT", "CONSTRAINT", "PRIMARY", "KEY", "FOREIGN", "REFERENCES", "UNIQUE", "CHECK", "DEFAULT", "AUTO_INCREMENT", "SERIAL", "SEQUENCE", "RETURNING",
)
PIPELINE_STAGES = ("$match", "$group", "$project", "$sort", "$limit", "$skip", "$lookup", "$graphLookup", "$unwind", "$out", "$merge", "$unionWith", "$count", "$facet", "$bucket", "$addFields", "$replaceRoot", "$sample")


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def named_after(sql: Column, words: tuple[str, ...]) -> Column:
    """Distinct upper-cased names after words that introduce one, sorted. The last part of a name says whether it is one: two characters
    or more, and no keyword."""
    found = F.flatten(F.array(*[all_matches(sql, rf"(?i){word}\s+{NAME}") for word in words]))
    upper = F.array_distinct(F.transform(found, F.upper))
    last = lambda x: F.substring_index(x, ".", -1)
    return F.array_sort(F.filter(upper, lambda x: (F.char_length(last(x)) >= 2) & ~last(x).isin(*STOP_WORDS)))


def tables(sql: Column) -> Column:
    """Table names of a statement."""
    return named_after(sql, BEFORE_TABLE)


def procedures(sql: Column) -> Column:
    """Procedure names of call escapes, CALL, EXEC and BEGIN."""
    return named_after(sql, BEFORE_PROCEDURE)


def sequences(sql: Column) -> Column:
    """``[schema.]sequence.NEXTVAL`` and ``CURRVAL`` as name:operation."""
    rx = r"(?i)((?:\w+\.)?\w+)\.(NEXTVAL|CURRVAL)\b"
    return F.array_sort(F.transform(F.arrays_zip(all_matches(sql, rx, 1).alias("n"), all_matches(sql, rx, 2).alias("o")), lambda x: F.upper(F.concat_ws(":", x["n"], x["o"]))))


def literals(expression: Column) -> Column:
    """String literals, doubled quotes made single."""
    return F.transform(all_matches(expression, r"'((?:[^']|'')*)'"), lambda x: F.replace(x, F.lit("''"), F.lit("'")))


def dynamic_tables(expression: Column) -> Column:
    """Tables of dynamic SQL: of the joined literals and of each."""
    parts = literals(expression)
    return F.array_sort(F.array_distinct(F.concat(tables(F.array_join(parts, "")), F.flatten(F.transform(parts, tables)))))


def blanked(code: Column) -> Column:
    """Code without comments and literals."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "), r"'(?:[^']|'')*'", "''")


def embedded_calls(code: Column) -> Column:
    """``package.function`` before an opening bracket, outside comments and literals."""
    return F.array_sort(F.array_distinct(F.transform(all_matches(blanked(code), r"\b([A-Za-z_]\w*\.[A-Za-z_]\w*)\s*\("), F.upper)))


def trigger_dml(body: Column) -> Column:
    """Operation and table of a trigger body's statements."""
    b = blanked(body)
    each = []
    for words, op in ((r"INSERT\s+INTO", "INSERT"), ("UPDATE", "UPDATE"), (r"DELETE\s+FROM", "DELETE"), (r"MERGE\s+INTO", "MERGE")):
        each.append(_tagged(all_matches(b, rf"(?i)\b{words}\s+{NAME}"), op))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*each))))


def _tagged(names: Column, op: str) -> Column:
    return F.transform(names, lambda x: F.concat_ws(":", F.lit(op), F.upper(x)))


def pipeline_refs(text: Column) -> Column:
    """Collections that pipeline stages name."""
    rx = (r"""\$(?:lookup|graphLookup)\W+from\W+(\w+)""", r"""["']\$out["']\W+(\w+)""", r"""\$merge\W+into\W+(\w+)""", r"""\$unionWith\W+(?:coll\W+)?(\w+)""")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[all_matches(text, r) for r in rx]))))


def pipeline_stages(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, PIPELINE_STAGES)), lambda s: F.instr(text, s) > 0)


def first_url(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.rlike("^https?://")), F.lit(0))


def signature(name: Column, types: Column) -> Column:
    """Method name with its parameter types, packages off."""
    return F.concat(name, F.lit("("), F.array_join(F.transform(types, lambda x: F.substring_index(x, ".", -1)), ", "), F.lit(")"))


def joined_path(base: Column, sub: Column) -> Column:
    """Two path parts as one, single slashes, none at the end."""
    raw = F.concat(F.lit("/"), F.coalesce(base, F.lit("")), F.lit("/"), F.coalesce(sub, F.lit("")))
    return F.regexp_replace(F.regexp_replace(raw, "/+", "/"), "(.)/$", "$1")


def masked_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, "://([^:/@]+):([^@]+)@", "://$1:***@")


def filled(template: Column, values: dict[str, Column]) -> Column:
    """``{{key}}`` replaced by values."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), v)
    return template


@F.pandas_udf(StringType())
def json_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The JSON object of a free text: the whole text if it begins with one, else a fenced block, else the first balanced braces."""

    def of(text: str | None) -> str | None:
        text = (text or "").strip()
        if text.startswith("{"):
            return text
        if fenced := re.search(r"```json[^\n]*\n(.+?)```", text, re.S):
            return fenced[1].strip()
        depth = 0
        for m in re.finditer("[{}]", text):
            if not depth:
                if m[0] == "}":
                    continue
                begin = m.start()
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return text[begin : m.end()]
        return None

    for x in texts:
        yield x.map(of, na_action=None)


@F.pandas_udf(StringType())
def subprogram_source(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The source of a procedure or function in a unit: from its header to the END that names it, else to the END of its first block."""

    def of(source: str | None, name: str | None) -> str | None:
        if not source or not name or not (head := re.search(rf"(?i)\b(?:PROCEDURE|FUNCTION)\s+{re.escape(name)}\b", source)):
            return None
        rest = source[head.start() :]
        if named := re.search(rf"(?is)\bEND\s+{re.escape(name)}\s*;", rest):
            return rest[: named.end()]
        depth = 0
        for m in re.finditer(r"(?i)\b(?:BEGIN|END)\b", rest):
            opens = m[0].upper() == "BEGIN"
            if not opens and not depth:
                continue
            depth += 1 if opens else -1
            if not depth:
                stop = rest.find(";", m.end())
                return rest[: stop + 1 if stop >= 0 else m.end()]
        return None

    for source, name in rows:
        yield pd.Series([of(s, n) for s, n in zip(source, name, strict=True)], dtype=object)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
