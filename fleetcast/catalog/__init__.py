"""Registered queries over the given tables, and the SQL each is checked against."""

from __future__ import annotations

from fleetcast.catalog import feature_queries, forecast_queries, ingest_queries, score_queries, stream_queries, training_queries, weather_queries
from fleetcast.catalog.base import CHECKS, QUERIES, Query

__all__ = ["checks", "feature_queries", "forecast_queries", "ingest_queries", "queries", "score_queries", "stream_queries", "training_queries", "weather_queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
