"""Catalogue of queries by name."""

from scriptorium.plans import intake, live, rendering, sequences, state, timeline  # noqa: F401  they register their queries
from scriptorium.plans.texts import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
