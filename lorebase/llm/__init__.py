"""Operators for building training data. Nothing else in the library imports this package."""

from lorebase.llm import queries
from lorebase.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "queries"]
