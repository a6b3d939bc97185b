"""Structured Streaming jobs."""

from stevedore.streaming.follow import compact_ingested, follow_logs, ingest_daily, run_to_path
from stevedore.streaming.records import follow_records

__all__ = ["compact_ingested", "follow_logs", "follow_records", "ingest_daily", "run_to_path"]
