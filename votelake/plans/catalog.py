"""All queries of the library by name, with their DuckDB counterparts."""

from __future__ import annotations

from votelake.plans import analysis_queries, brief_queries, label_queries, model_queries, text_queries  # noqa: F401
from votelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
