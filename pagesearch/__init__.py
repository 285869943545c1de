"""Positioned full-text search over digitised pages, as Spark DataFrames."""

from .config import SearchConfig
from .plans.search import search, search_matches

__all__ = ["SearchConfig", "search", "search_matches"]
