"""All queries of the retrieval operators and the SQL that states the same rows."""

from __future__ import annotations

from gleaner.plans import changes, engine_parts, files, graphs, memory, operations, results, search, sources, texts  # noqa: F401
from gleaner.registry import ORACLES, QUERIES  # noqa: F401
