"""Every registered query and, where SQL can express it, its DuckDB oracle."""

from __future__ import annotations

from . import oracles
from .operators import custom
from .plans import contracts, planning, reconcile, runs, samples

QUERIES = {name: f for m in (runs, planning, contracts, reconcile, samples, custom) for name, f in m.QUERIES.items()}
ORACLE_SQL = oracles.SQL
