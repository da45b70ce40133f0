"""Named queries over the driver tables and the SQL that states the same rows."""

from __future__ import annotations

from . import datasets, files, markup, reports, rewards, rows, tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _plan in (reports, datasets, tables, rewards, markup, files, rows):
    QUERIES.update(_plan.QUERIES)
    ORACLE_SQL.update(_plan.ORACLE_SQL)
