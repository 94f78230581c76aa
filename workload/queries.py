"""All registered queries."""

from __future__ import annotations

from . import indicators, strategies, scans, chains, learning, sources, sweeps  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
