"""Registered queries over the given tables, each beside its SQL twin where one exists."""

from . import expressions, joins, metrics, models, quality, ranks, splits  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
