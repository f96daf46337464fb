"""All registered queries and their oracles (import side effects register them)."""

from __future__ import annotations

from lodestar.plans import core, features, io, models, profiles, streams  # noqa: F401
from lodestar.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
