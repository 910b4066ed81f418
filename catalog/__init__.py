"""Registered queries: each pairs a Spark job over whole tables with the SQL that checks it."""

from catalog.base import QUERIES
from catalog import charts, neighbors, objectives, scores, signals, tables  # noqa: F401

__all__ = ["QUERIES"]
