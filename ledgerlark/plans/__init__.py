"""Query plans over the adapters, with their oracle SQL."""

from ledgerlark.plans import aggregates, audit_queries, backfill_queries, bundle_queries, core, filters, graph_queries, reader_queries, resolution_queries, rule_queries, scalar_queries, search_queries, signal_queries, sink_queries, stream_queries  # noqa: F401
from ledgerlark.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
