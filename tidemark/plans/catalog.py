"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from tidemark.plans import (  # noqa: F401
    archive_queries,
    feature_queries,
    ingest_queries,
    membership_queries,
    screen_queries,
    sealed_queries,
    store_queries,
    view_queries,
)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
