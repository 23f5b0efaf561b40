"""Facts from PL/SQL source: a tokenizer and a single pass over the tokens of each unit.

``facts(sources)`` gives one row for each fact: subprograms, table operations with the subquery they stand in, joins, calls with
their argument counts, cursors, sequences, filters, loops, handlers, transaction control. Later stages are DataFrame code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, kind string, proc string, name string, op string, line int, detail string"
TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"[^"]+"|[A-Za-z_][\w$#]*(?:%\w+)?|\d+(?:\.\d+)?|:=|=>|\|\||<>|!=|\^=|<=|>=|\.\.|\(\+\)|.""", re.S)
# Words that are no calls, and words that end a table reference.
KEYWORDS = frozenset("""ALL AND ANY AS BEGIN BETWEEN BULK BY CASE CLOSE COLLECT COMMIT CONNECT CONSTANT CROSS CURSOR DECLARE DELETE DISTINCT ELSE ELSIF END ESCAPE EXCEPTION EXECUTE EXISTS EXIT FETCH FOR FORALL
    FROM FULL FUNCTION GROUP HAVING IF IMMEDIATE IN INNER INSERT INTERSECT INTO IS JOIN LEFT LIKE LOOP MATCHED MERGE MINUS NATURAL NOT NULL OF ON OPEN OR ORDER OUTER OVER PACKAGE PARTITION PRAGMA PRIOR PROCEDURE
    RAISE RETURN RETURNING RIGHT ROLLBACK SAVEPOINT SELECT SET SOME START THEN TRIGGER TYPE UNION UPDATE USING VALUES WHEN WHERE WHILE WITH""".split())
ACCESS = {"FROM": "SELECT", "JOIN": "SELECT", "INTO": "INSERT", "UPDATE": "UPDATE", "USING": "SELECT"}


def tokens(text: str) -> list[tuple[str, int]]:
    """Tokens with their lines, without blanks and comments."""
    out, line = [], 1
    for m in TOKEN.finditer(text):
        t = m.group()
        if not t.isspace() and not t.startswith(("--", "/*")):
            out.append((t, line))
        line += t.count("\n")
    return out


class Pass:
    """One pass over the tokens of a source."""

    def __init__(self, text: str):
        self.toks = tokens(text)
        self.up = [t.upper() for t, _ in self.toks]
        self.rows: list[tuple] = []
        self.proc = ""
        self.ctes: set[str] = set()

    def word(self, i: int) -> str:
        return self.up[i] if 0 <= i < len(self.up) else ""

    def name_at(self, i: int) -> tuple[str, int]:
        """A dotted name from a token on, and the token after it."""
        if not re.match(r'[A-Za-z_"]', self.word(i)) or self.word(i) in KEYWORDS:
            return "", i
        parts = [self.word(i).strip('"')]
        while self.word(i + 1) == "." and re.match(r'[A-Za-z_"]', self.word(i + 2)):
            parts.append(self.word(i + 2).strip('"'))
            i += 2
        return ".".join(parts), i + 1

    def add(self, kind: str, i: int, name: str = "", op: str = "", detail: str = "") -> None:
        self.rows.append((kind, self.proc, name, op, self.toks[i][1], detail))

    def context(self, opens: list[str]) -> str:
        return next((c for c in reversed(opens) if c), "")

    def table(self, i: int, op: str, opens: list[str]) -> None:
        name, after = self.name_at(i)
        if name and name != "DUAL" and self.word(after) != "(" and ("." in name or name not in self.ctes):
            self.add("table", i, name, op, self.context(opens))

    def arguments(self, i: int) -> int:
        """Arguments of the bracket that opens at a token."""
        depth, n = 0, 0
        for j in range(i, len(self.up)):
            t = self.up[j]
            depth += (t == "(") - (t == ")")
            if not depth:
                return 0 if j == i + 1 else n + 1
            n += depth == 1 and t == ","
        return n

    def run(self) -> list[tuple]:
        opens: list[str] = []
        statement, loops, i = "", 0, 0
        while i < len(self.up):
            t, before = self.up[i], self.word(i - 1)
            if t == "(":
                is_query = self.word(i + 1) in ("SELECT", "WITH")
                around = {"FROM": "FROM", "JOIN": "FROM", "EXISTS": "EXISTS", "ALL": "ALL", "ANY": "ANY", "SOME": "ANY", ",": "FROM" if statement == "FROM" else "SCALAR"}
                opens.append(("NOT_IN" if self.word(i - 2) == "NOT" else "IN") if is_query and before == "IN" else around.get(before, "SCALAR") if is_query else "")
            elif t == ")" and opens:
                opens.pop()
            elif t in ("PROCEDURE", "FUNCTION") and before != "END":
                name, after = self.name_at(i + 1)
                if name:
                    self.proc = name
                    self.add("subprogram", i, name, t)
            elif t in ("PACKAGE", "TRIGGER") and before in ("REPLACE", "CREATE", "EDITIONABLE", ""):
                name, _ = self.name_at(i + 2 if self.word(i + 1) == "BODY" else i + 1)
                self.add("unit", i, name, t + (" BODY" if self.word(i + 1) == "BODY" else ""))
            elif t == "CURSOR":
                self.add("cursor", i, self.name_at(i + 1)[0], "DECLARE")
            elif t in ("OPEN", "FETCH", "CLOSE") and self.name_at(i + 1)[0]:
                self.add("cursor", i, self.name_at(i + 1)[0], t, "REF" if t == "OPEN" and self.word(self.name_at(i + 1)[1]) == "FOR" else "")
            elif t == "WITH" and self.word(i + 2) in ("AS", "("):
                self.ctes.add(self.word(i + 1))
            elif t == "AS" and self.word(i + 1) == "(" and before not in KEYWORDS:
                self.ctes.add(before)
            elif t in ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE") and before not in ("FOR", "THEN" if t not in ("INSERT", "UPDATE", "DELETE") else "", "OR", "BEFORE", "AFTER", ","):
                statement = t
                merge_branch = before == "THEN" and t in ("INSERT", "UPDATE", "DELETE") and "MATCHED" in self.up[max(0, i - 4) : i]
                if not merge_branch:
                    self.add("statement", i, op=t)
                if t == "UPDATE" and not merge_branch:
                    self.table(i + 1, "UPDATE", opens)
                elif t == "DELETE" and not merge_branch:
                    self.table(i + 2 if self.word(i + 1) == "FROM" else i + 1, "DELETE", opens)
            elif t == "INTO" and before in ("INSERT", "MERGE"):
                self.table(i + 1, before, opens)
            elif t in ("FROM", "JOIN", "USING") and not (t == "FROM" and before == "DELETE") and not (t == "USING" and self.word(i + 1) == "("):
                statement = "FROM" if t == "FROM" else statement
                self.table(i + 1, "SELECT", opens)
                if t == "JOIN":
                    kind = " ".join(w for w in self.up[max(0, i - 3) : i] if w in ("LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL", "INNER")) or "INNER"
                    self.add("join", i, self.name_at(i + 1)[0], kind)
            elif t == "APPLY":
                self.add("join", i, self.name_at(i + 1)[0], before + " APPLY")
            elif t == "," and statement == "FROM" and not (opens and opens[-1] == ""):
                name, after = self.name_at(i + 1)
                if name and self.word(after) not in ("=", "."):
                    self.table(i + 1, "SELECT", opens)
                    self.add("join", i, name, "IMPLICIT")
            elif t in ("WHERE", "SET", "GROUP", "ORDER", ";"):
                statement = t
            elif t in ("LOOP", "FORALL") and before != "END":
                loops += t == "LOOP"
                self.add("loop", i, op=t, detail=str(loops))
            elif t == "END":
                loops -= self.word(i + 1) == "LOOP"
            elif t in ("COMMIT", "ROLLBACK", "SAVEPOINT", "RAISE"):
                self.add("control", i, self.name_at(i + 1)[0], t)
            elif t == "EXECUTE" and self.word(i + 1) == "IMMEDIATE":
                self.add("dynamic", i, op="EXECUTE IMMEDIATE", detail=self.toks[i + 2][0] if i + 2 < len(self.toks) else "")
            elif t == "WHEN" and statement != "MERGE" and self.word(i + 2) == "THEN" and "EXCEPTION" in self.up[max(0, i - 400) : i]:
                self.add("handler", i, self.word(i + 1))
            elif t in ("NEXTVAL", "CURRVAL") and before == ".":
                schema = self.word(i - 4) + "." if self.word(i - 3) == "." else ""
                self.add("sequence", i, schema + self.word(i - 2), t)
            elif t in ("=", "<", ">", "<=", ">=", "<>", "!=", "^=", "LIKE", "BETWEEN", "IN", "IS") and statement == "WHERE" and re.match(r"[A-Z_]", before):
                self.add("filter", i, before, "<>" if t in ("!=", "^=") else t, self.toks[i + 1][0] if i + 1 < len(self.toks) else "")
            if re.match(r"[A-Z_]", t) and t not in KEYWORDS and before not in (".", "PROCEDURE", "FUNCTION", "CURSOR", "INTO", "TYPE", "TABLE"):
                name, after = self.name_at(i)
                if name and self.word(after) in ("(", ";") and (self.word(after) == "(" or before in (";", "BEGIN", "THEN", "ELSE", "LOOP")) and statement not in ("INSERT",):
                    self.add("call", i, name, "CALL", str(self.arguments(after)) if self.word(after) == "(" else "0")
            i += 1
        return self.rows


def facts(sources: DataFrame) -> DataFrame:
    """Facts of ``sources(path, text)``; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["text"], strict=True):
                rows = [(path, *r) for r in Pass(text or "").run()]
                yield pd.DataFrame(rows, columns=["path", "kind", "proc", "name", "op", "line", "detail"])

    return sources.select("path", "text").mapInPandas(run, SCHEMA)
