"""Log data derived from the given tables, each with its SQL twin for the oracle.

Every frame is a projection or aggregation of a whole table, so it grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.plans.logs_view import canonical_logs

AS_OF = "2024-01-31 00:00:00"
T_FROM, T_TO = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


_views: dict[tuple[str, str, str], DataFrame] = {}


def _view(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An analysed frame (a plan, no data), built once per application like a view of a catalog."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _views:
        _views[key] = build()
    return _views[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _view(spark, sf_dir, name, lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# -- logs ------------------------------------------------------------------------

_LOG_FIELDS = """
  lpad(CAST(event_id AS STRING), 12, '0') AS id,
  concat('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id,
  concat('svc-', CAST(user_id % 10 AS STRING)) AS source_id,
  concat('svc-', CAST(user_id % 10 AS STRING)) AS service,
  CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Metric' WHEN 'view' THEN 'Metric'
    WHEN 'signup' THEN 'Audit' ELSE 'Application' END AS log_type,
  CASE WHEN event_type = 'error' AND value >= 100 THEN 'Fatal' WHEN event_type = 'error' THEN 'Error'
    WHEN event_type = 'signup' THEN 'Warning' ELSE 'Information' END AS level,
  CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS environment,
  CASE event_type WHEN 'purchase' THEN 'http-latency' WHEN 'view' THEN 'http-request' WHEN 'error' THEN 'exception'
    WHEN 'signup' THEN 'alert' ELSE 'event' END AS category,
  ts AS timestamp,
  {ms} AS timestamp_unix_ms,
  concat(event_type, ' k=', {k}) AS message,
  concat('trace-', CAST(event_id % 2000 AS STRING)) AS trace_id,
  CASE event_type WHEN 'purchase' THEN value WHEN 'view' THEN CAST(1.0 AS DOUBLE) END AS metric_value,
  value AS duration_ms,
  CASE WHEN event_type = 'error' THEN 500 + CAST({k} AS INT) % 4 WHEN event_type = 'view' THEN 200 END AS status_code,
  concat('/api/', event_type, '/', CAST(user_id % 20 AS STRING)) AS endpoint,
  {k} AS tag_k,
  CASE WHEN event_type = 'view' THEN CAST(200 + CAST({k} AS INT) % 5 AS STRING) END AS tag_http_status
"""

_LOGS_SPARK = "SELECT *, " + _LOG_FIELDS.format(
    ms="unix_millis(CAST(ts AS TIMESTAMP))", k="get_json_object(props, '$.k')"
) + " FROM {events}"

LOGS = (
    "WITH logs AS (SELECT "
    + _LOG_FIELDS.format(ms="epoch_us(ts) // 1000", k="json_extract_string(props, '$.k')")
    + """,
  ts + INTERVAL 3 SECOND AS ingested_at,
  strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour,
  CAST(extract('hour' FROM ts) AS INTEGER) AS hour_of_day, CAST(dayofweek(ts) AS INTEGER) AS day_of_week,
  CASE user_id % 4 WHEN 0 THEN 'Counter' WHEN 1 THEN 'Gauge' WHEN 2 THEN 'Histogram' ELSE 'Summary' END AS metric_type,
  event_id, user_id, value, event_type
 FROM events)
"""
)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical `logs` view over the events table."""
    return _view(spark, sf_dir, "logs", lambda: _build_logs(spark, sf_dir))


def _build_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.sql(_LOGS_SPARK, events=table(spark, sf_dir, "events"))
    kind = F.element_at(F.array(*map(F.lit, ["Counter", "Gauge", "Histogram", "Summary"])), (F.col("user_id") % 4 + 1).cast("int"))
    entries = base.withColumns(
        {
            "stack_trace": F.lit(None).cast("string"),
            "tags": F.map_filter(
                F.create_map(
                    F.lit("k"), "tag_k",
                    F.lit("region"), F.concat(F.lit("region-"), (F.col("user_id") % 5).cast("string")),
                    F.lit("http_status"), "tag_http_status",
                ),
                lambda _, v: v.isNotNull(),
            ),
            "metric": F.when(
                F.col("metric_value").isNotNull(),
                F.struct(
                    F.col("category").alias("metric_name"),
                    F.lit("ms").alias("unit"),
                    F.col("metric_value").alias("value"),
                    kind.alias("metric_type"),
                ),
            ),
            "ingested_at": F.col("ts") + F.expr("INTERVAL 3 SECONDS"),
            "ingestion_mode": F.lit("Push"),
            "schema_version": F.lit(1),
        }
    )
    return canonical_logs(entries.drop("event_id", "ts", "user_id", "event_type", "value", "props"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the stored entry columns only."""
    from loglake.schema import LOG_ENTRY

    rows = logs(spark, sf_dir).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return rows.select(*LOG_ENTRY.fieldNames())


# -- incoming entries, some of them broken -----------------------------------------

_DTO_FIELDS = """
  event_id,
  concat('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id,
  CASE event_id % 50 WHEN 1 THEN '' WHEN 2 THEN 'bad source' WHEN 3 THEN repeat('s', 257)
    ELSE concat('svc-', CAST(user_id % 10 AS STRING)) END AS source_id,
  CASE WHEN event_id % 50 = 4 THEN 'Unknown' WHEN event_id % 50 = 5 THEN '  ' WHEN event_id % 50 IN (12, 13, 14, 15) THEN 'metric'
    WHEN event_type = 'purchase' THEN 'Metric' WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'audit'
    ELSE 'Application' END AS log_type,
  CASE WHEN event_id % 50 = 6 THEN 'Loud' WHEN event_id % 50 = 7 THEN NULL WHEN event_type = 'error' THEN 'error'
    ELSE 'Information' END AS level,
  CASE event_id % 50 WHEN 8 THEN repeat('e', 65) WHEN 9 THEN '' ELSE 'prod' END AS environment,
  CASE WHEN event_type = 'view' THEN 'http-request' END AS category,
  CASE event_id % 50 WHEN 10 THEN {as_of} + INTERVAL 6 MINUTE WHEN 11 THEN ts - INTERVAL 40 DAY WHEN 16 THEN NULL
    ELSE ts END AS timestamp,
  CASE WHEN event_id % 50 = 17 THEN ' ' WHEN event_id % 1000 = 18 THEN repeat('x', 65537) ELSE concat(event_type, ' ', props) END AS message,
  CASE WHEN event_id % 2 = 0 THEN concat('trace-', CAST(event_id % 2000 AS STRING)) END AS trace_id,
  CAST(NULL AS STRING) AS stack_trace
"""

_DTOS_SPARK = "SELECT " + _DTO_FIELDS.format(as_of=f"TIMESTAMP_NTZ '{AS_OF}'") + """,
  CASE event_id % 50
    WHEN 19 THEN map_from_entries(transform(sequence(1, 51), i -> struct(concat('t', i), 'v')))
    WHEN 20 THEN map(repeat('k', 129), 'v') WHEN 21 THEN map('k', repeat('v', 1025)) WHEN 22 THEN NULL
    ELSE map('k', get_json_object(props, '$.k')) END AS tags,
  CASE WHEN event_id % 50 = 12 THEN NULL
    WHEN event_id % 50 = 13 THEN named_struct('metric_name', '', 'unit', 'ms', 'value', value, 'metric_type', 'gauge')
    WHEN event_id % 50 = 14 THEN named_struct('metric_name', 'lat', 'unit', '  ', 'value', value, 'metric_type', 'gauge')
    WHEN event_id % 50 = 15 OR event_type = 'purchase'
      THEN named_struct('metric_name', 'http-latency', 'unit', 'ms', 'value', value, 'metric_type', 'histogram') END AS metric
  FROM {events}"""

DTOS = "WITH dtos AS (SELECT " + _DTO_FIELDS.format(as_of=f"TIMESTAMP '{AS_OF}'") + """,
  CASE event_id % 50 WHEN 19 THEN 51 WHEN 22 THEN NULL ELSE 1 END AS tag_count,
  CASE event_id % 50 WHEN 20 THEN 129 ELSE 3 END AS tag_key_length,
  CASE event_id % 50 WHEN 21 THEN 1025 ELSE 2 END AS tag_value_length,
  CASE WHEN event_id % 50 = 12 THEN NULL WHEN event_id % 50 = 13 THEN '' WHEN event_id % 50 = 14 THEN 'lat'
    WHEN event_id % 50 = 15 OR event_type = 'purchase' THEN 'http-latency' END AS metric_name,
  CASE WHEN event_id % 50 = 12 THEN NULL WHEN event_id % 50 = 14 THEN '  '
    WHEN event_id % 50 IN (13, 15) OR event_type = 'purchase' THEN 'ms' END AS metric_unit,
  value, json_extract_string(props, '$.k') AS tag_k, event_type
 FROM events),
validated AS (SELECT *, list_filter([
  CASE WHEN trim(coalesce(source_id, '')) = '' THEN 'source_id is empty' END,
  CASE WHEN length(source_id) > 256 THEN 'source_id is too long' END,
  CASE WHEN NOT regexp_full_match(coalesce(source_id, ''), '[a-zA-Z0-9_.:/-]+') THEN 'source_id has invalid characters' END,
  CASE WHEN trim(coalesce(log_type, '')) = '' THEN 'log_type is empty' END,
  CASE WHEN coalesce(lower(trim(log_type)), '') NOT IN ('application', 'error', 'network', 'os', 'metric', 'audit', 'custom') THEN 'log_type is unknown' END,
  CASE WHEN trim(coalesce(level, '')) = '' THEN 'level is empty' END,
  CASE WHEN coalesce(lower(trim(level)), '') NOT IN ('trace', 'debug', 'information', 'warning', 'error', 'fatal') THEN 'level is unknown' END,
  CASE WHEN trim(coalesce(environment, '')) = '' THEN 'environment is empty' END,
  CASE WHEN length(environment) > 64 THEN 'environment is too long' END,
  CASE WHEN timestamp IS NULL THEN 'timestamp is empty' END,
  CASE WHEN timestamp > TIMESTAMP '2024-01-31 00:05:00' THEN 'timestamp is in the future' END,
  CASE WHEN timestamp <= TIMESTAMP '2024-01-01 00:00:00' THEN 'timestamp is too old' END,
  CASE WHEN trim(coalesce(message, '')) = '' THEN 'message is empty' END,
  CASE WHEN length(message) > 65536 THEN 'message is too long' END,
  CASE WHEN tag_count > 50 THEN 'too many tags' END,
  CASE WHEN tag_key_length > 128 THEN 'tag key is too long' END,
  CASE WHEN tag_value_length > 1024 THEN 'tag value is too long' END,
  CASE WHEN lower(log_type) = 'metric' AND metric_name IS NULL THEN 'metric is missing' END,
  CASE WHEN lower(log_type) = 'metric' AND trim(metric_name) = '' THEN 'metric name is empty' END,
  CASE WHEN lower(log_type) = 'metric' AND trim(metric_unit) = '' THEN 'metric unit is empty' END
  ], lambda x: x IS NOT NULL) AS errors FROM dtos)
"""


def dtos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DTOS_SPARK, events=table(spark, sf_dir, "events"))


# -- deliveries: entries that arrive more than once; one id holds a third of all rows ----------

_DELIVERY_FIELDS = """
  concat('tenant-', CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 4 END AS STRING)) AS tenant_id,
  CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE concat('e-', CAST(event_id % 3000 AS STRING)) END AS id,
  ts AS ingested_at,
  event_id AS delivery,
  concat(event_type, ' ', props) AS message
"""

DELIVERIES = f"WITH deliveries AS (SELECT {_DELIVERY_FIELDS} FROM events)\n"


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT {_DELIVERY_FIELDS} FROM {{events}}", events=table(spark, sf_dir, "events"))


# -- query log ---------------------------------------------------------------------

_QLOG_FIELDS = """
  lpad(CAST(event_id AS STRING), 12, '0') AS query_id,
  concat('tenant-', CAST(user_id % 8 AS STRING)) AS tenant_id,
  ts AS submitted_at,
  CASE event_type
    WHEN 'view' THEN concat('SELECT service FROM logs WHERE timestamp >= ''', {d1}, ''' AND timestamp < ''', {d2}, ''' LIMIT ', {k})
    WHEN 'click' THEN concat('SELECT count(*) FROM logs a CROSS  JOIN logs b WHERE a.day = ''', {k}, '''')
    WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'DROP TABLE logs' WHEN 1 THEN 'SELECT 1; DELETE FROM logs'
      ELSE concat('select ''', {d1}, ''' as d, updated_at from logs where message = ''', {d2}, ' 10:11:12.5+02:00''') END
    WHEN 'signup' THEN concat('SELECT * FROM logs WHERE SEARCH(''timeout'') AND timestamp >= ''', {d1}, 'T00:00:00Z''')
    ELSE 'SELECT 1 AS result' END AS sql,
  event_type = 'signup' AND event_id % 2 = 0 AS has_full_text,
  CAST(floor(value * 1000000000) AS BIGINT) AS estimated_bytes,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS earliest,
  {latest} AS latest,
  CASE event_id % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE 'model-c' END AS model,
  CAST({k} AS INT) * 10 AS input_tokens,
  CAST({k} AS INT) + 7 AS output_tokens
"""

_QLOG_SPARK = "SELECT " + _QLOG_FIELDS.format(
    k="get_json_object(props, '$.k')",
    d1="date_format(ts, 'yyyy-MM-dd')",
    d2="date_format(ts + make_dt_interval(CAST(event_id % 20 AS INT)), 'yyyy-MM-dd')",
    latest="ts + make_dt_interval(CAST(event_id % 20 AS INT))",
) + " FROM {events}"

QLOG = "WITH qlog AS (SELECT " + _QLOG_FIELDS.format(
    k="json_extract_string(props, '$.k')",
    d1="strftime(ts, '%Y-%m-%d')",
    d2="strftime(ts + to_days(CAST(event_id % 20 AS INTEGER)), '%Y-%m-%d')",
    latest="ts + to_days(CAST(event_id % 20 AS INTEGER))",
) + " FROM events)\n"


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_QLOG_SPARK, events=table(spark, sf_dir, "events"))


# -- tenant settings ---------------------------------------------------------------

_SETTINGS_FIELDS = """
  concat('tenant-', CAST(n_nationkey AS STRING)) AS tenant_id,
  CAST(CASE n_nationkey WHEN 0 THEN 0 ELSE n_nationkey + 2 END AS INT) AS hot_retention_days,
  CAST(CASE n_nationkey WHEN 1 THEN -1 ELSE 10 + n_nationkey END AS INT) AS warm_retention_days,
  CAST(n_nationkey * 15 AS DOUBLE) AS max_query_scan_gb,
  n_nationkey % 2 = 0 AS require_time_filter,
  n_nationkey % 3 = 0 AS require_limit,
  n_nationkey <> 5 AS is_active
"""

SETTINGS = f"settings AS (SELECT {_SETTINGS_FIELDS} FROM nation WHERE n_nationkey <> 3)\n"


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return spark.sql(f"SELECT {_SETTINGS_FIELDS} FROM {{nation}} WHERE n_nationkey <> 3", nation=nation)


# -- alert rules -------------------------------------------------------------------

_RULE_FIELDS = """
  CAST(c_custkey AS STRING) AS rule_id,
  concat('tenant-', CAST(c_custkey % 4 AS STRING)) AS tenant_id,
  c_name AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'sum' WHEN 2 THEN 'avg' ELSE 'max' END AS measure,
  CASE c_custkey % 3 WHEN 1 THEN 'Error' WHEN 2 THEN 'Metric' END AS log_type,
  CASE c_custkey % 5 WHEN 0 THEN 'Fatal' WHEN 1 THEN 'Error' WHEN 2 THEN 'Information' END AS level,
  CASE CAST(floor(c_custkey / 8) AS INT) % 8 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 15 WHEN 3 THEN 30 WHEN 4 THEN 60 WHEN 5 THEN 120
    WHEN 6 THEN 360 ELSE 1440 END AS window_minutes,
  CASE c_custkey % 8 WHEN 0 THEN '>' WHEN 1 THEN '<' WHEN 2 THEN '>=' WHEN 3 THEN '<=' WHEN 4 THEN '==' WHEN 5 THEN '=' WHEN 6 THEN ' > '
    ELSE '!=' END AS threshold_operator,
  CAST(CAST(floor(abs(c_acctbal) / 100) AS INT) AS DOUBLE) + CASE c_custkey % 4 WHEN 0 THEN CAST(0 AS DOUBLE) ELSE CAST(0.00031 AS DOUBLE) END AS threshold_value,
  c_custkey % 7 <> 0 AS is_enabled,
  CAST(60 * (1 + c_custkey % 30) AS INT) AS evaluation_interval_seconds,
  CASE c_custkey % 3 WHEN 0 THEN 'slack' WHEN 1 THEN 'webhook' END AS notification_channel
"""

_DESTINATIONS = """
  CASE c_custkey % 4
    WHEN 0 THEN CAST(array() AS ARRAY<STRUCT<type STRING, webhook_url STRING, integration_key STRING>>)
    WHEN 1 THEN array(named_struct('type', 'Slack', 'webhook_url', 'https://hooks.example.com/a', 'integration_key', CAST(NULL AS STRING)))
    WHEN 2 THEN array(
      named_struct('type', 'webhook', 'webhook_url', 'http://example.com/b', 'integration_key', 'key'),
      named_struct('type', ' slack ', 'webhook_url', 'http://localhost:9000/c', 'integration_key', CAST(NULL AS STRING)))
    ELSE array(named_struct('type', 'email', 'webhook_url', 'https://example.com/d', 'integration_key', CAST(NULL AS STRING)))
  END AS destinations
"""

RULES = f"rules AS (SELECT {_RULE_FIELDS} FROM customer)\n"


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return spark.sql(f"SELECT {_RULE_FIELDS}, {_DESTINATIONS} FROM {{customer}}", customer=customer)


# -- tag schema versions -------------------------------------------------------------

_FIELD_ROWS = """
SELECT concat('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id,
  CAST(1 + floor({dayno} / 6) AS INT) AS version,
  concat(event_type, '_', {k}) AS name,
  CASE WHEN max(value) > 60 THEN 'string' WHEN max(value) > 30 THEN 'double' WHEN max(value) > 20 THEN 'float'
    WHEN max(value) > 10 THEN 'int64' ELSE 'int32' END AS inferred_type,
  count(*) < 3 AS is_nullable,
  min(value) < 5 AS is_deprecated
FROM {events} GROUP BY 1, 2, 3
"""

FIELDS = "WITH fields AS (" + _FIELD_ROWS.format(
    dayno="(extract('day' FROM ts) - 1)", k="json_extract_string(props, '$.k')", events="events"
) + ")\n"


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field rows of schema versions: one version per tenant and six days."""
    sql = _FIELD_ROWS.format(dayno="(day(ts) - 1)", k="get_json_object(props, '$.k')", events="{events}")
    return spark.sql(sql, events=table(spark, sf_dir, "events"))
