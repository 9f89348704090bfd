"""All named queries of the core, with their SQL."""

from __future__ import annotations

from tamarisk.plans import function_queries, other_queries, quality, report_queries, search_queries, table_queries, text_queries
from tamarisk.plans.registry import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _m in (text_queries, table_queries, search_queries, report_queries, function_queries, other_queries, quality):
    QUERIES |= _m.R.queries
    SQL |= _m.R.sql
