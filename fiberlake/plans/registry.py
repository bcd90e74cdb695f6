"""Registered queries and their SQL."""

from __future__ import annotations

from fiberlake.plans import fiber_queries, pixel_queries

_ALL = {**pixel_queries.QUERIES, **fiber_queries.QUERIES}
QUERIES = {name: f for name, (f, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
