"""Every registered query of the behavioural engine, with its DuckDB counterpart."""

from __future__ import annotations

from sessionlake.plans.oracles import ORACLES
from sessionlake.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
