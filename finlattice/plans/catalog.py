"""Every registered query of the core library, with its DuckDB counterpart."""

from __future__ import annotations

from finlattice.plans import coverage, derivation, filings, library, lines, quality, search, state  # noqa: F401  each registers its queries
from finlattice.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
