"""Column expressions shared by the jobs (all built-in Spark functions, no UDFs)."""

from stevedore.functions.layouts import (
    LOG_FIELDS,
    format_bracket,
    format_log4j_line,
    format_log4j_thread,
    log_fields,
    split_log_line,
)
from stevedore.functions.levels import SEVERITY_RANK, severity_rank
from stevedore.functions.secrets import HIDDEN, SECRET_NAME_PATTERN, mask_secret

__all__ = [
    "HIDDEN",
    "LOG_FIELDS",
    "SECRET_NAME_PATTERN",
    "SEVERITY_RANK",
    "format_bracket",
    "format_log4j_line",
    "format_log4j_thread",
    "mask_secret",
    "log_fields",
    "severity_rank",
    "split_log_line",
]
