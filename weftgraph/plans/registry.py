"""All queries of the engine and the DuckDB SQL with the same rows."""

from __future__ import annotations

from weftgraph.plans.oracle import ORACLE
from weftgraph.plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
