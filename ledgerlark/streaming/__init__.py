"""Structured Streaming counterparts of the stateful steps."""

from ledgerlark.streaming.jobs import deduplicated, events, finished, sessions, tumbling, upserting
from ledgerlark.streaming.quota import QuotaRun

__all__ = ["QuotaRun", "deduplicated", "events", "finished", "sessions", "tumbling", "upserting"]
