"""All registered measurement queries."""

from probelake.queries import counter_queries, counter_tier_queries, dimension_queries, incident_queries, ingest_queries, overview_queries, probe_queries, route_queries, series_queries, sketch_queries, stored_queries, stream_queries, tier_queries  # noqa: F401
from probelake.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
