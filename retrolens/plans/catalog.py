"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import logs, sources, streams, workload  # noqa: F401  each adds its queries
from .logs import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
