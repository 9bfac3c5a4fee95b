"""All queries of the price engine with the SQL that checks them."""

from __future__ import annotations

from . import q_aggregates, q_captures, q_documents, q_extras, q_joins, q_references, q_rules, q_scalars, q_sources, q_stateful, q_ticks, q_work  # noqa: F401
from .registering import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
