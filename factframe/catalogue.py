"""All registered queries of the library and their DuckDB oracles."""

from __future__ import annotations

from factframe.plans import citing, claims, connectors, evaluation, events, filings, ingest, letters, matching, passages, provenance, rebuild, report, scalars, series, stores, streams, text, trees  # noqa: F401  (they register queries)
from factframe.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
