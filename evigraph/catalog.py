"""Queries by name, and the SQL that gives the same rows."""

from .plans.iterate import tidied
from .queries import evidence, graph, relations, slices, sources

_MODULES = (graph, relations, evidence, sources, slices)
QUERIES: dict = {k: tidied(v) for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
