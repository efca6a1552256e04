"""All queries of the engine and their SQL."""

from __future__ import annotations

from tessera.plans import layers, relational, shapes, spatial, textual

PARTS = (relational, spatial, textual, layers, shapes)
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL = {k: s for p in PARTS for k, s in p.ORACLE_SQL.items()}
