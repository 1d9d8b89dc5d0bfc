"""All queries of the core, and their SQL."""

from __future__ import annotations

from lodestone.plans import catalog, data_quality, graphs, programs, relational, schemas, services

_MODULES = (data_quality, graphs, relational, schemas, programs, catalog, services)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
