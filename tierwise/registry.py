"""All registered queries and their oracle SQL."""

from __future__ import annotations

from tierwise.oracle import findings_sql, market_sql, period_sql, signals_sql
from tierwise.plans import finding_queries, market_queries, metric_queries, signal_queries

_QUERIES = (metric_queries, signal_queries, finding_queries, market_queries)
_ORACLES = (period_sql, signals_sql, findings_sql, market_sql)


def queries():
    return {k: q for module in _QUERIES for k, q in module.queries().items()}


def oracle_sql():
    return {k: q for module in _ORACLES for k, q in module.sql().items()}
