"""Queries and their SQL twins."""

from __future__ import annotations

from tracelake.plans import agenda, directory, finance, identity, messages, relations, state, stored, telemetry, upkeep
from tracelake.streaming import live, queries

_MODULES = (telemetry, messages, finance, relations, agenda, upkeep, identity, state, directory, stored, live, queries)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
