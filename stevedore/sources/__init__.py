"""Readers for text logs and settings files."""

from stevedore.sources.logs import attach_records, parse_logs, read_log_lines
from stevedore.sources.settings import compare_settings, extract_settings, malformed_settings

__all__ = ["attach_records", "compare_settings", "extract_settings", "malformed_settings", "parse_logs", "read_log_lines"]
