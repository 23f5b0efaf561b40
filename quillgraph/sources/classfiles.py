"""Class files to facts, by the published class-file format: classes, methods and the calls in their code.

Reading bytes is beyond built-in functions, so a pandas function parses a class at a time; everything after is DataFrame code.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "archive string, class string, super string, kind string, name string, descriptor string, target string, ord int, interfaces array<string>, annotations array<string>"
# Sizes of constant pool entries by tag, and of instructions by opcode ranges (fixed values of the format).
POOL = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
TWO = {16, 18, 21, 22, 23, 24, 25, 54, 55, 56, 57, 58, 169, 188}
THREE = {17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199}
CALLS = {182: "VIRTUAL", 183: "SPECIAL", 184: "STATIC", 185: "INTERFACE", 186: "DYNAMIC"}


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def u(self, size: int) -> int:
        v = int.from_bytes(self.data[self.at : self.at + size], "big")
        self.at += size
        return v

    def pool(self) -> dict[int, tuple]:
        out, i, n = {}, 1, self.u(2)
        while i < n:
            tag = self.u(1)
            if tag == 1:
                size = self.u(2)
                out[i] = (1, self.data[self.at : self.at + size].decode("utf-8", "replace"))
                self.at += size
            elif tag in POOL:
                body = self.data[self.at : self.at + POOL[tag]]
                out[i] = (tag, *struct.unpack(">HH" if len(body) == 4 else ">H", body)) if tag not in (3, 4, 5, 6, 15) else (tag,)
                self.at += POOL[tag]
            else:
                raise ValueError(f"constant pool tag {tag}")
            i += 2 if tag in (5, 6) else 1
        return out


def parse(data: bytes) -> Iterator[tuple]:
    """Rows ``(class, super, kind, name, descriptor, target, ord, interfaces, annotations)``; raises ValueError on anything but a class file."""
    r = Reader(data)
    if r.u(4) != 0xCAFEBABE:
        raise ValueError("no class file")
    r.at += 4
    pool = r.pool()
    text = lambda i: pool[i][1] if i in pool else ""
    name_of = lambda i: text(pool[i][1]).replace("/", ".") if i in pool else ""
    r.at += 2
    this, parent = name_of(r.u(2)), name_of(r.u(2))
    interfaces = [name_of(r.u(2)) for _ in range(r.u(2))]

    def notes(at: int) -> list[str]:
        """Annotation types up to the first with arguments, whose length the format does not tell ahead."""
        a, out = Reader(r.data), []
        a.at = at
        for _ in range(a.u(2)):
            out.append(text(a.u(2)).strip("L;").replace("/", "."))
            if a.u(2):
                break
        return out

    def attributes() -> Iterator[tuple[str, int, int]]:
        for _ in range(r.u(2)):
            name, size = text(r.u(2)), r.u(4)
            yield name, r.at, size
            r.at += size

    def calls(at: int, size: int) -> Iterator[tuple[int, str, str, str]]:
        i, end = at, at + size
        while i < end:
            op = r.data[i]
            if op in CALLS:
                ref = pool.get(int.from_bytes(r.data[i + 1 : i + 3], "big"), (0, 0, 0))
                pair = pool.get(ref[2], (0, 0, 0))
                yield op, name_of(ref[1]) if op != 186 else "", text(pair[1]), text(pair[2])
            if op in (170, 171):  # switches, aligned to four
                j = i + 4 - (i - at) % 4
                low, high = (int.from_bytes(r.data[j + 4 * k : j + 4 * k + 4], "big", signed=True) for k in (1, 2))
                i = j + 12 + 4 * (high - low + 1) if op == 170 else j + 8 + 8 * low
            elif op == 196:
                i += 6 if r.data[i + 1] == 132 else 4
            else:
                i += 5 if op in (185, 186, 200, 201) else 4 if op == 197 else 3 if op in THREE else 2 if op in TWO else 1

    rows = []
    for kind in ("field", "method"):
        for k in range(r.u(2)):
            r.at += 2
            name, descriptor, found, marked = text(r.u(2)), text(r.u(2)), [], []
            for attribute, at, _ in attributes():
                if attribute == "RuntimeVisibleAnnotations":
                    marked = notes(at)
                elif attribute == "Code":
                    size = int.from_bytes(r.data[at + 4 : at + 8], "big")
                    found = list(calls(at + 8, size))
            rows.append((this, parent, kind, name, descriptor, "", k, interfaces, marked))
            rows += [(this, parent, "call", f"{name}{descriptor}", CALLS[op], f"{owner}#{callee}{signature}", n, interfaces, []) for n, (op, owner, callee, signature) in enumerate(found)]
    own = [x for attribute, at, _ in attributes() if attribute == "RuntimeVisibleAnnotations" for x in notes(at)]
    yield this, parent, "class", this, "", "", 0, interfaces, own
    yield from rows


def facts(entries: DataFrame) -> DataFrame:
    """Facts of ``entries(archive, entry, content)``; an entry that is no class file gives one row of kind ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for archive, entry, content in zip(b["archive"], b["entry"], b["content"], strict=True):
                if not entry.endswith(".class"):
                    continue
                try:
                    rows = [(archive, *x) for x in parse(bytes(content))]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows = [(archive, entry, "", "error", str(e), "", "", 0, [], [])]
                yield pd.DataFrame(rows, columns=names)

    return entries.select("archive", "entry", "content").mapInPandas(run, SCHEMA)
