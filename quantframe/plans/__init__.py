"""Registered queries of the engine's operators."""

from . import aggregates, io, joins, metrics, research, scans, strategies, streams, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
