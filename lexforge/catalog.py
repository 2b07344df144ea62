"""Every query of the engine by name, with the SQL it is checked against."""

from __future__ import annotations

from lexforge.plans import codebase, contexts, debt, evidence, figures, links, passes, records, retrieval, scans, selection, stores, views  # noqa: F401
from lexforge.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
