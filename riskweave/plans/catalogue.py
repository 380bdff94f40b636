"""All registered queries. Importing the modules fills the registry."""

from __future__ import annotations

from riskweave.plans import (  # noqa: F401
    batch_queries,
    feature_queries,
    filter_queries,
    monitoring_queries,
    movement_queries,
    retrieval_queries,
    scan_queries,
    stream_queries,
    text_queries,
    training_queries,
)
from riskweave.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
