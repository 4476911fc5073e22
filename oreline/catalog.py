"""All registered queries and their SQL, by name."""

from __future__ import annotations

from .plans import factcheck, matching, reports, scalars, sources, specs, streams  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
