"""All registered queries of the library's own operators, with the SQL they are held against."""

from __future__ import annotations

from .catalog import classifying, dictionary, filtering, graphs, joining, packing, rollups, streams, surface, texts  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
