"""Table, change, history, log and reconcile jobs."""

from stevedore.operators.changes import evolve_append, evolve_table, fold_batches, merge_into_path, merge_upsert
from stevedore.operators.history import latest_per_key, retain_history, retain_in_place, snapshot_as_of
from stevedore.operators.logs import error_tail, error_verdict, filter_severity, keep_newest_days, write_daily
from stevedore.operators.reconcile import reconcile, reconcile_ranges, reconcile_summary
from stevedore.operators.tables import (
    append_rows,
    compact,
    compact_in_place,
    optimized_write,
    overwrite_partitions,
    overwrite_table_partitions,
    publish_external,
    publish_table,
    read_evolved,
    replace_table,
)

__all__ = [
    "append_rows",
    "compact",
    "compact_in_place",
    "error_tail",
    "error_verdict",
    "evolve_append",
    "evolve_table",
    "filter_severity",
    "fold_batches",
    "keep_newest_days",
    "latest_per_key",
    "merge_into_path",
    "merge_upsert",
    "optimized_write",
    "overwrite_partitions",
    "overwrite_table_partitions",
    "publish_external",
    "publish_table",
    "read_evolved",
    "reconcile",
    "reconcile_ranges",
    "reconcile_summary",
    "replace_table",
    "retain_history",
    "retain_in_place",
    "snapshot_as_of",
    "write_daily",
]
