"""Registered queries of the core, gathered from its query modules."""

from __future__ import annotations

from passagemill.plans import assign_queries, base, ingest_queries, numeric_queries, pipeline_queries, training_queries

QUERIES, ORACLES = base.QUERIES, base.ORACLES
__all__ = ["ORACLES", "QUERIES", "assign_queries", "ingest_queries", "numeric_queries", "pipeline_queries", "training_queries"]
