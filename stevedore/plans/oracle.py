"""DuckDB SQL giving the expected result of each case in ``cases.py``.

Tables are the pre-registered views of the test parquet files.  Column names and
types follow the Spark results (BIGINT counts, INTEGER ranks, TIMESTAMP for
Spark's TIMESTAMP_NTZ).
"""

from __future__ import annotations

from stevedore.plans.fixtures import (
    AS_OF,
    EVENT_LEVEL,
    LOGGER,
    MERGE_TARGET_END,
    RECONCILE_ACTUAL_FROM,
    RECONCILE_EXPECTED_TO,
    SPLIT_DATE,
)

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
EVENTS = "event_id, ts, user_id, event_type, value, props"
LOG_COLS = "source, ts, level, thread, logger, line_no, message, raw"
# Fixed value: the words that mark an error line.
ERROR_RE = "error|exception|failed"

_level = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_LEVEL.items()) + " ELSE 'UNKNOWN' END"

# The event-made log lines, parsed: what parse_logs must return.
def parsed_logs_cte(source_sql: str = "'user-' || CAST(user_id AS VARCHAR)") -> str:
    return f"""parsed AS (
  WITH ev AS (
    SELECT event_id, ts, event_type,
           {_level} AS level,
           event_id % 3 AS layout,
           {source_sql} AS source,
           event_type || ' event ' || CAST(event_id AS VARCHAR) || ' props ' || props AS message,
           'session-' || CAST(user_id AS VARCHAR) AS thread0,
           CAST(event_id % 997 + 1 AS INTEGER) AS line0
    FROM events)
  SELECT source,
         CASE layout WHEN 0 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END AS ts,
         level,
         CASE WHEN layout = 1 THEN thread0 END AS thread,
         CASE WHEN layout <> 0 THEN '{LOGGER}' END AS logger,
         CASE WHEN layout = 2 THEN line0 END AS line_no,
         message,
         CASE layout
           WHEN 0 THEN '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || level || '] ' || message
           WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' ' || rpad(level, 5, ' ') || ' [' || thread0
                       || '] {LOGGER} - ' || message
           ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' ' || rpad(level, 5, ' ') || ' {LOGGER}:'
                || CAST(line0 AS VARCHAR) || ' - ' || message
         END AS raw,
         2 * event_id AS seq,
         CASE layout WHEN 0 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END AS record_ts,
         level AS record_level
  FROM ev
  UNION ALL
  SELECT source, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
         CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR),
         'java.lang.IllegalStateException: event ' || CAST(event_id AS VARCHAR) || ' failed',
         2 * event_id + 1,
         CASE layout WHEN 0 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END,
         level
  FROM ev WHERE event_type = 'error')"""


PARSED_LOGS = parsed_logs_cte()

ORACLE_SQL: dict[str, str] = {
    "publish_managed": f"SELECT {ORDERS} FROM orders",
    "publish_external": f"SELECT {ORDERS} FROM orders",
    "append_rows": f"SELECT {ORDERS} FROM orders",
    "merge_upsert": f"""
        SELECT {ORDERS} FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT_DATE}'
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT_DATE}' AND o_orderstatus <> 'F'""",
    "merge_into_path": f"""
        SELECT {ORDERS}, nullif(strftime(o_orderdate, '%m'), '12') AS o_month
        FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT_DATE}' AND month(o_orderdate) <> 2
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority,
               nullif(strftime(o_orderdate, '%m'), '12') AS o_month
        FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT_DATE}' AND o_orderstatus <> 'F' AND month(o_orderdate) <> 2""",
    "evolve_append": f"""
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderdate < TIMESTAMP '{SPLIT_DATE}' THEN o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority,
               CASE WHEN o_orderdate >= TIMESTAMP '{SPLIT_DATE}' THEN o_orderstatus END AS o_orderstatus
        FROM orders""",
    "evolve_table": f"""
        SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS o_year,
               CASE WHEN o_orderdate < TIMESTAMP '{SPLIT_DATE}' THEN o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority,
               CASE WHEN o_orderdate >= TIMESTAMP '{SPLIT_DATE}' THEN o_orderstatus END AS o_orderstatus
        FROM orders""",
    "snapshot_as_of": f"""
        SELECT {EVENTS} FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
          FROM events WHERE ts <= TIMESTAMP '{AS_OF}')
        WHERE r = 1 AND event_type <> 'error'""",
    "retain_history": f"""
        WITH h AS (SELECT *, ts < (SELECT max(ts) - INTERVAL 168 HOUR FROM events) AS old FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, old ORDER BY ts DESC, event_id DESC) AS rn FROM h)
        SELECT {EVENTS} FROM r WHERE NOT old OR rn = 1""",
    "retain_in_place": f"""
        WITH h AS (SELECT *, ts < (SELECT date_trunc('day', max(ts) - INTERVAL 168 HOUR) FROM events) AS old FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, old ORDER BY ts DESC, event_id DESC) AS rn FROM h)
        SELECT {EVENTS} FROM r WHERE NOT old OR rn = 1""",
    "optimized_write": f"SELECT {ORDERS} FROM orders",
    "compact": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus, l_shipdate
        FROM lineitem""",
    "compact_evolved": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' THEN l_linestatus END AS l_linestatus, l_shipdate,
               nullif(strftime(l_shipdate, '%m'), '12') AS l_month
        FROM lineitem""",
    "merge_evolved": f"""
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
               CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' THEN o_orderpriority END AS o_orderpriority,
               nullif(strftime(o_orderdate, '%m'), '12') AS o_month,
               CASE WHEN o_orderdate >= TIMESTAMP '{SPLIT_DATE}' THEN o_totalprice + 1 END AS o_restated
        FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT_DATE}' OR o_orderstatus <> 'F'""",
    "overwrite_partitions": f"""
        SELECT {ORDERS} FROM orders WHERE o_orderstatus <> 'F'
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '{MERGE_TARGET_END}'""",
    "fold_batches": f"""
        WITH b AS (SELECT *, CAST(isodow(ts) - 1 AS INTEGER) AS batch FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch DESC, ts DESC, event_id DESC) AS rn
              FROM b),
        n AS (SELECT user_id, count(DISTINCT batch) AS n_batches FROM b GROUP BY user_id)
        SELECT r.event_id, r.ts, r.user_id, r.event_type, r.value, r.props, r.batch, n.n_batches
        FROM r JOIN n ON r.user_id = n.user_id WHERE r.rn = 1""",
    "parse_logs": f"WITH {PARSED_LOGS} SELECT {LOG_COLS} FROM parsed",
    "parse_log_files": f"""
        WITH {parsed_logs_cte("CAST(CAST(ts AS DATE) AS VARCHAR)")} SELECT {LOG_COLS}, record_ts, record_level FROM parsed""",
    "filter_severity": f"WITH {PARSED_LOGS} SELECT {LOG_COLS} FROM parsed WHERE level IN ('WARN', 'ERROR')",
    "filter_severity_unranked": f"""
        WITH {PARSED_LOGS} SELECT {LOG_COLS} FROM parsed
        WHERE level IS NULL OR level NOT IN ('TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL')""",
    "error_tail": f"""
        WITH {PARSED_LOGS}
        SELECT * FROM (
          SELECT {LOG_COLS},
                 CAST(row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS INTEGER)
                   AS recency
          FROM parsed WHERE regexp_matches(raw, '{ERROR_RE}', 'i'))
        WHERE recency <= 10""",
    "error_verdict": f"""
        WITH {PARSED_LOGS}
        SELECT source, count(*) AS n_lines,
               count(*) FILTER (WHERE regexp_matches(raw, '{ERROR_RE}', 'i')) AS n_errors,
               count(*) FILTER (WHERE regexp_matches(raw, '{ERROR_RE}', 'i')) > 0 AS has_errors
        FROM parsed GROUP BY source""",
    "write_daily": f"""
        WITH {PARSED_LOGS}
        SELECT CAST(CAST(record_ts AS DATE) AS TIMESTAMP) AS day, count(*) AS n FROM parsed
        GROUP BY CAST(record_ts AS DATE)""",
    "write_daily_files": f"""
        WITH {PARSED_LOGS}
        SELECT CAST(CAST(record_ts AS DATE) AS TIMESTAMP) AS day, count(*) AS n, count(*) FILTER (ts IS NULL) AS n_traces FROM parsed
        GROUP BY CAST(record_ts AS DATE)""",
    "keep_newest_days": f"""
        WITH {PARSED_LOGS}
        SELECT {LOG_COLS} FROM parsed
        WHERE CAST(record_ts AS DATE) IN (
          SELECT DISTINCT CAST(ts AS DATE) FROM parsed WHERE ts IS NOT NULL ORDER BY 1 DESC LIMIT 7)""",
    "follow_logs": f"""
        WITH {PARSED_LOGS}
        SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
               level, count(*) AS n
        FROM parsed WHERE ts IS NOT NULL
        GROUP BY date_trunc('hour', ts), level""",
    "follow_records": f"""
        WITH {PARSED_LOGS}
        SELECT date_trunc('hour', record_ts) AS window_start, date_trunc('hour', record_ts) + INTERVAL 1 HOUR AS window_end,
               record_level AS level, count(*) AS n
        FROM parsed GROUP BY date_trunc('hour', record_ts), record_level""",
    "extract_settings_xml": """
        SELECT 'order.' || CAST(o_orderkey AS VARCHAR) || '.status' AS name, o_orderstatus AS value, o_orderpriority
        FROM orders
        UNION ALL
        SELECT 'order.' || CAST(o_orderkey AS VARCHAR) || '.password' AS name, '[HIDDEN]' AS value, o_orderpriority
        FROM orders""",
    "extract_settings_kv": """
        SELECT 'CUSTOMER_' || CAST(c_custkey AS VARCHAR) || '_NAME' AS name, trim(c_name) AS value, c_mktsegment
        FROM customer
        UNION ALL
        SELECT 'CUSTOMER_' || CAST(c_custkey AS VARCHAR) || '_TOKEN' AS name, '[HIDDEN]' AS value, c_mktsegment
        FROM customer""",
    "reconcile": f"""
        SELECT o_orderkey,
               CASE WHEN o_orderdate >= TIMESTAMP '{RECONCILE_EXPECTED_TO}' THEN 'extra'
                    WHEN o_orderdate < TIMESTAMP '{RECONCILE_ACTUAL_FROM}' THEN 'missing'
                    ELSE 'changed' END AS status,
               CASE WHEN o_orderdate >= TIMESTAMP '{RECONCILE_ACTUAL_FROM}'
                         AND o_orderdate < TIMESTAMP '{RECONCILE_EXPECTED_TO}'
                    THEN CASE o_orderpriority WHEN '5-LOW' THEN 'o_totalprice' WHEN '1-URGENT' THEN 'o_orderstatus' END
               END AS changed_columns
        FROM orders
        WHERE o_orderdate < TIMESTAMP '{RECONCILE_ACTUAL_FROM}'
           OR o_orderdate >= TIMESTAMP '{RECONCILE_EXPECTED_TO}'
           OR o_orderpriority IN ('5-LOW', '1-URGENT')""",
}

ORACLE_SQL["reconcile_ranges"] = ORACLE_SQL["reconcile"]
ORACLE_SQL["merge_colocated"] = ORACLE_SQL["merge_upsert"]
ORACLE_SQL["merge_table"] = ORACLE_SQL["merge_upsert"]
ORACLE_SQL["ingest_daily"] = ORACLE_SQL["write_daily"]
ORACLE_SQL["compact_in_place"] = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus, l_shipdate, nullif(strftime(l_shipdate, '%m'), '12') AS l_month
    FROM lineitem"""
ORACLE_SQL["overwrite_table_partitions"] = ORACLE_SQL["overwrite_partitions"]
ORACLE_SQL["replace_table"] = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority,
           'o_orderstatus' AS layout
    FROM orders"""

ORACLE_SQL["extract_settings_conf"] = """
    WITH c AS (SELECT c_name, CAST(c_custkey AS VARCHAR) AS k, 'host-' || CAST(c_nationkey AS VARCHAR) AS host FROM customer)
    SELECT 'customer.' || k || '.name' AS name, trim(c_name) AS value, host, 'host=' || host AS folder FROM c
    UNION ALL
    SELECT 'customer.' || k || '.api_key', '[HIDDEN]', host, 'host=' || host FROM c"""

ORACLE_SQL["settings_drift"] = f"""
    WITH o AS (
      SELECT *, 'order.' || CAST(o_orderkey AS VARCHAR) AS k, o_orderdate < TIMESTAMP '{RECONCILE_ACTUAL_FROM}' AS gone
      FROM orders)
    SELECT o_orderpriority, k || '.status' AS name, CASE WHEN gone THEN 'missing' ELSE 'changed' END AS status,
           o_orderstatus AS expected, CASE WHEN NOT gone THEN lower(o_orderstatus) END AS actual
    FROM o WHERE gone OR o_orderpriority = '2-HIGH'
    UNION ALL
    SELECT o_orderpriority, k || '.password', CASE WHEN gone THEN 'missing' ELSE 'changed' END,
           '[HIDDEN]', CASE WHEN NOT gone THEN '[HIDDEN]' END
    FROM o WHERE gone OR o_orderpriority = '5-LOW'"""

ORACLE_SQL["reconcile_summary"] = f"""
    SELECT status, count(*) AS n FROM ({ORACLE_SQL["reconcile"]}) GROUP BY status"""
