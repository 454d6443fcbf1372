"""All named queries of the search engine and its lab."""

from . import lab, more, search  # noqa: F401  each module registers its queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
