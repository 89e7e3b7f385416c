"""Registered queries over the supplied tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from lorebase.catalogue import branches, chunks, derived, feeds, maintain, pages, records, streams, texts
from lorebase.catalogue.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "branches", "chunks", "derived", "feeds", "maintain", "pages", "records", "streams", "texts"]
