"""All registered queries and their SQL equivalents."""

from . import analytics, extensions, layouts, relational, retrieval, streams  # noqa: F401  they register their queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
