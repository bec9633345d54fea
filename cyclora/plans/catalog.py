"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from cyclora.plans import features, files, numeric, relational, structure  # noqa: F401  they register their queries
from cyclora.plans.registry import OPERATORS, ORACLES, QUERIES

__all__ = ["OPERATORS", "ORACLES", "QUERIES"]
