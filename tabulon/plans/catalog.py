"""Registered queries of the core library and their DuckDB twins."""

from __future__ import annotations

from tabulon.plans import q_clean, q_drift, q_extra, q_features, q_forest, q_models, q_more, q_profile, q_series, q_stages, q_streams, q_tests, q_text  # noqa: F401
from tabulon.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
