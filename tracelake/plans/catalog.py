"""All registered queries of the trace engine and their DuckDB twins."""

from __future__ import annotations

from tracelake.plans import aggregates, gates, ordered, records, sourced, texts, workflows  # noqa: F401
from tracelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
