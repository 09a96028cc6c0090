"""All registered queries of the library proper, with the SQL that gives the same rows."""

from __future__ import annotations

from . import audit_queries, more_queries, network_queries, polygon_queries, project_queries, risk_queries, track_queries, traffic_queries, voyage_queries

_MODULES = (track_queries, traffic_queries, network_queries, project_queries, risk_queries, more_queries, audit_queries, polygon_queries, voyage_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
