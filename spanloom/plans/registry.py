"""Queries of the text-to-graph engine and their SQL counterparts, by name."""

from __future__ import annotations

from spanloom.plans import calls, entity, evaluation, flagship, stages, text

QUERIES = {k: v for m in (calls, text, entity, stages, evaluation, flagship) for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in (calls, text, entity, stages, evaluation, flagship) for k, v in m.ORACLE_SQL.items()}
