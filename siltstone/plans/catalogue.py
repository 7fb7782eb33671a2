"""All queries of the library over the test tables, by name."""

from __future__ import annotations

from . import analytics, documents, generated, geometry, requests, retrieval
from .common import Query

_PARTS = (retrieval.REGISTRY, analytics.REGISTRY, documents.REGISTRY, generated.REGISTRY, geometry.REGISTRY, requests.REGISTRY)
QUERIES: dict[str, Query] = {k: v for part in _PARTS for k, v in part.queries.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.sql.items()}
