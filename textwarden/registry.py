"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from .plans import job_queries, risk_queries, text_queries

MODULES = [risk_queries, text_queries, job_queries]
QUERIES: dict = {}
SQL: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
