"""Operators of a training-data pipeline. Nothing outside this package imports it.

``queries()`` and ``oracle_sql()`` are what the entry module adds when this package is present.
"""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
