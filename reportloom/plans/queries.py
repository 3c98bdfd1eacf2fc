"""Registered queries of the core operators and their SQL."""

from __future__ import annotations

from reportloom.plans import retrieval_queries, sheet_queries, stage_queries, stats_queries, text_queries  # noqa: F401
from reportloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
