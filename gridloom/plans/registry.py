"""Every query of the library and its SQL twin, by name."""

from __future__ import annotations

from . import documents, flows, layers, nested, plan_layers, relational, scalars, shapes, tables

QUERIES: dict = relational.QUERIES | documents.QUERIES | flows.QUERIES | layers.QUERIES | nested.QUERIES | plan_layers.QUERIES | scalars.QUERIES | shapes.QUERIES | tables.QUERIES
SQL: dict[str, str] = relational.SQL | documents.SQL | flows.SQL | layers.SQL | nested.SQL | plan_layers.SQL | scalars.SQL | shapes.SQL | tables.SQL
