"""All registered queries of the library and their SQL."""

from __future__ import annotations

from vellum.plans import layouts, texts  # noqa: F401  register their queries
from vellum.plans.relational import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
