"""All queries and their SQL, by name."""

from __future__ import annotations

from spliceflow.plans import oracles, pipeline_oracles, pipelines, queries

QUERIES = queries.QUERIES | pipelines.QUERIES
ORACLES = oracles.ORACLES | pipeline_oracles.ORACLES
