"""Operators of a large-scale text pipeline; nothing else in the package imports them."""

from kartograf.llm.queries import QUERIES

__all__ = ["QUERIES"]
