"""DuckDB SQL that says what the queries must give, written apart from them."""

from . import contracts, custom, planning, reconcile, runs, samples

SQL = runs.QUERIES | planning.QUERIES | contracts.QUERIES | reconcile.QUERIES | samples.QUERIES | samples.SCALARS | custom.QUERIES
