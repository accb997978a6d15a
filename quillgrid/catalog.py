"""Registered queries of the formula engine and their SQL."""

from __future__ import annotations

from quillgrid.queries import relations, scalars
from quillgrid.queries.base import Catalog

_catalog = Catalog()
for _module in (relations, scalars):
    _module.register(_catalog)

QUERIES, ORACLE_SQL = _catalog.queries, _catalog.sql
