"""All registered queries and their oracle SQL."""

from __future__ import annotations

from strandline.plans import classification, composition, enrichment, geography, quality, register, selection, sequences, tallies  # noqa: F401
from strandline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
