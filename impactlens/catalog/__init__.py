"""The registered queries and, where SQL can say the same, their reference SQL."""

from impactlens.catalog.registry import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
