"""Registered queries with their SQL counterparts."""

from sparquill.queries import answers, chunks, texts, vectors  # noqa: F401
from sparquill.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
