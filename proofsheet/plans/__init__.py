"""Registered queries."""

from . import evaluating, imaging, registering, rendering, review, streams
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "evaluating", "imaging", "registering", "rendering", "review", "streams"]
