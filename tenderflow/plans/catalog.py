"""All queries of the engine and their SQL."""

from . import documents, fields, scores, streams  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
