"""Queries V1–V12, S5, S8, S9, W1–W4, J2: validation, normalisation and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake import schema
from loglake.functions import columns as C
from loglake.operators import dedup as D
from loglake.operators import ingest as I
from loglake.plans.fixtures import AS_OF, DELIVERIES, DTOS, LOGS, deliveries, dtos, entries, logs, table
from loglake.plans.registry import query
from loglake.sources.batches import from_batches, next_since, pull_since, pull_state_since

_INGESTED = "2024-01-31 00:00:00"


def _checked(spark, sf):
    return I.validate_entries(dtos(spark, sf), AS_OF)


@query(
    "v1_validate_entries",
    DTOS + "SELECT event_id, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS is_valid FROM validated",
)
def _(spark, sf):
    return _checked(spark, sf).select("event_id", F.array_join("errors", "; ").alias("errors"), "is_valid")


@query(
    "v2_ingest_summary",
    DTOS + """SELECT tenant_id, count(*) FILTER (len(errors) = 0) AS accepted, count(*) FILTER (len(errors) > 0) AS rejected
    FROM validated GROUP BY 1""",
)
def _(spark, sf):
    return I.ingest_summary(_checked(spark, sf), "tenant_id")


@query("v2_accepted", DTOS + "SELECT event_id, message FROM validated WHERE len(errors) = 0")
def _(spark, sf):
    return I.split_valid(_checked(spark, sf))[0].select("event_id", "message")


_CANON = """CASE lower(trim(log_type)) WHEN 'application' THEN 'Application' WHEN 'error' THEN 'Error' WHEN 'network' THEN 'Network'
  WHEN 'os' THEN 'OS' WHEN 'metric' THEN 'Metric' WHEN 'audit' THEN 'Audit' WHEN 'custom' THEN 'Custom' END"""
_CANON_LEVEL = """CASE lower(trim(level)) WHEN 'trace' THEN 'Trace' WHEN 'debug' THEN 'Debug' WHEN 'information' THEN 'Information' WHEN 'info' THEN 'Information'
  WHEN 'warning' THEN 'Warning' WHEN 'warn' THEN 'Warning' WHEN 'error' THEN 'Error' WHEN 'fatal' THEN 'Fatal' END"""


@query("v3_canonical_enums", DTOS + f"SELECT event_id, {_CANON} AS log_type, {_CANON_LEVEL} AS level FROM dtos")
def _(spark, sf):
    return I.canonical_enums(dtos(spark, sf)).select("event_id", "log_type", "level")


@query(
    "v4_to_entries",
    DTOS + f"""SELECT tenant_id, source_id, {_CANON} AS log_type, {_CANON_LEVEL} AS level, environment, category, epoch_us(timestamp) // 1000 AS timestamp_unix_ms,
      message, trace_id, coalesce(tag_count, 0) AS tag_count, CASE WHEN metric_name IS NOT NULL THEN CASE WHEN event_id % 50 IN (13, 14) THEN 'Gauge' ELSE 'Histogram' END END AS metric_type,
      TIMESTAMP '{_INGESTED}' AS ingested_at, 'Push' AS ingestion_mode, 1 AS schema_version
    FROM validated WHERE len(errors) = 0""",
)
def _(spark, sf):
    accepted, _ = I.split_valid(_checked(spark, sf))
    rows = I.to_entries(accepted, F.col("tenant_id"), "Push", _INGESTED)
    return rows.select(
        "tenant_id", "source_id", "log_type", "level", "environment", "category", "timestamp_unix_ms", "message", "trace_id",
        F.size("tags").alias("tag_count"), F.col("metric.metric_type").alias("metric_type"), "ingested_at", "ingestion_mode", "schema_version",
    )


@query(
    "v5_to_dtos",
    LOGS + """SELECT source_id, log_type, level, environment, category, make_timestamp(timestamp_unix_ms * 1000) AS timestamp, message, trace_id,
      metric_value FROM logs""",
)
def _(spark, sf):
    rows = I.to_dtos(entries(spark, sf))
    return rows.select(
        "source_id", "log_type", "level", "environment", "category", "timestamp", "message", "trace_id", F.col("metric.value").alias("metric_value")
    )


_TAGS_JSON = """concat('{"k":"', tag_k, '","region":"region-', CAST(user_id % 5 AS VARCHAR), '"', CASE WHEN tag_http_status IS NOT NULL
  THEN concat(',"http_status":"', tag_http_status, '"') ELSE '' END, '}')"""


@query(
    "v6_to_archive_rows",
    LOGS + f"""SELECT id AS Id, source_id AS SourceId, log_type AS LogType, level AS Level, environment AS Environment, coalesce(category, '') AS Category,
      timestamp_unix_ms AS TimestampUnixMs, message AS Message, coalesce(trace_id, '') AS TraceId, tenant_id AS TenantId, 1 AS SchemaVersion, {_TAGS_JSON} AS Tags FROM logs""",
)
def _(spark, sf):
    return I.to_archive_rows(entries(spark, sf))


# An archive as replay may find it: odd spelling, blanks and broken tag text.
_DAMAGED_COLUMNS = [
    "lpad(CAST(event_id AS STRING), 12, '0') AS Id",
    "concat('svc-', CAST(user_id % 10 AS STRING)) AS SourceId",
    "CASE event_id % 5 WHEN 0 THEN 'METRIC' WHEN 1 THEN 'nonsense' ELSE 'Error' END AS LogType",
    "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'fatal' ELSE 'Warning' END AS Level",
    "'prod' AS Environment",
    "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE event_type END AS Category",
    "CAST(event_id AS BIGINT) AS TimestampUnixMs",
    "event_type AS Message",
    "CASE event_id % 4 WHEN 0 THEN '' ELSE concat('trace-', CAST(event_id AS STRING)) END AS TraceId",
    "CASE event_id % 6 WHEN 0 THEN ' ' ELSE concat('tenant-', CAST(user_id % 4 AS STRING)) END AS TenantId",
    "1 AS SchemaVersion",
    """CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '{"k": ' WHEN 2 THEN '{"k":"a","m":"b"}' ELSE '{"k":"c"}' END AS Tags""",
]


@query(
    "v7_from_archive_rows",
    "WITH r AS (SELECT " + ", ".join(_DAMAGED_COLUMNS) + """ FROM events)
    SELECT Id AS id, CASE lower(LogType) WHEN 'metric' THEN 'Metric' WHEN 'error' THEN 'Error' ELSE 'Application' END AS log_type,
      CASE lower(Level) WHEN 'fatal' THEN 'Fatal' WHEN 'warning' THEN 'Warning' ELSE 'Information' END AS level,
      nullif(trim(Category), '') AS category, nullif(trim(TraceId), '') AS trace_id, coalesce(nullif(trim(TenantId), ''), 'fallback') AS tenant_id,
      CASE WHEN Tags LIKE '%}' THEN json_extract_string(Tags, '$.k') END AS tag_k, 'Replay' AS ingestion_mode FROM r""",
)
def _(spark, sf):
    fields = [F.expr(x) for x in _DAMAGED_COLUMNS]
    rows = table(spark, sf, "events").select(*fields)
    back = I.from_archive_rows(rows, "fallback", _INGESTED)
    return back.select(
        "id", "log_type", "level", "category", "trace_id", "tenant_id", F.try_element_at("tags", F.lit("k")).alias("tag_k"), "ingestion_mode"
    )


@query(
    "v8_with_partitions",
    LOGS + """SELECT id, year, month, day, hour, concat_ws('/', tenant_id, year, month, day, hour) AS partition_path FROM logs""",
)
def _(spark, sf):
    rows = I.with_partitions(entries(spark, sf).withColumn("timestamp", F.timestamp_millis("timestamp_unix_ms")))
    return rows.select("id", "year", "month", "day", "hour", "partition_path")


@query(
    "v9_uuid7_time",
    LOGS + """SELECT id, timestamp_unix_ms AS created_ms, make_timestamp(timestamp_unix_ms * 1000) AS created_at, 32 AS id_length, '7' AS version FROM logs""",
)
def _(spark, sf):
    rows = entries(spark, sf).withColumn("u", C.uuid7(F.col("timestamp_unix_ms"), F.col("tenant_id"), F.col("id")))
    return rows.select(
        "id", C.uuid7_millis(F.col("u")).alias("created_ms"), C.uuid7_time(F.col("u")).alias("created_at"),
        F.length("u").alias("id_length"), F.substring("u", 13, 1).alias("version"),
    )


@query(
    "v10_to_documents",
    LOGS + """SELECT id, tenant_id, message, category, level, log_type, timestamp_unix_ms, make_timestamp(timestamp_unix_ms * 1000) AS timestamp, source_id,
      environment, trace_id, CAST(NULL AS VARCHAR) AS stack_trace, ingested_at, 'Push' AS ingestion_mode, 1 AS schema_version FROM logs""",
)
def _(spark, sf):
    return I.to_documents(entries(spark, sf)).drop("tags")


@query("v11_column_projection", LOGS + "SELECT timestamp, level, source_id, message FROM logs")
def _(spark, sf):
    return logs(spark, sf).select("timestamp", "level", "source_id", "message")


@query("v12_typed_tags", LOGS + "SELECT id, CAST(tag_k AS INTEGER) AS k, coalesce(CAST(tag_http_status AS INTEGER), -1) AS http_status, true AS region_is_null FROM logs")
def _(spark, sf):
    rows = I.typed_tags(logs(spark, sf), {"k": "int", "http_status": "int", "region": "boolean"})
    return rows.select("id", "k", F.coalesce("http_status", F.lit(-1)).alias("http_status"), F.isnull("region").alias("region_is_null"))




@query(
    "s5_pull_since",
    LOGS + """SELECT id, timestamp FROM logs WHERE timestamp > TIMESTAMP '2024-01-12 03:04:05'""",
)
def _(spark, sf):
    return pull_since(logs(spark, sf), "2024-01-12 03:04:05").select("id", "timestamp")


@query(
    "s5_next_state",
    LOGS + """, states AS (SELECT source_id, max(timestamp) AS last_event_timestamp FROM logs WHERE log_type <> 'Error' GROUP BY 1)
    SELECT source_id, last_event_timestamp, CASE source_id WHEN 'svc-1' THEN TIMESTAMP '2024-01-02 00:00:00' WHEN 'svc-2' THEN TIMESTAMP '2024-01-03 00:00:00'
      WHEN 'svc-3' THEN TIMESTAMP '2024-01-30 23:00:00' ELSE last_event_timestamp END AS since FROM states""",
)
def _(spark, sf):
    states = next_since(logs(spark, sf).filter("log_type <> 'Error'"), "source_id")
    s = F.col("source_id")
    none = F.lit(None).cast("timestamp_ntz")
    event = F.when(~s.isin("svc-1", "svc-2", "svc-3"), F.col("last_event_timestamp"))
    pulled = F.when(s == "svc-1", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).otherwise(none)
    ran = F.when(s == "svc-2", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).otherwise(none)
    return states.withColumn("since", pull_state_since(event, pulled, ran, F.lit(AS_OF).cast("timestamp_ntz")))


@query(
    "s8_from_batches",
    DTOS + """SELECT tenant_id, concat('batch-', CAST(event_id // 100 AS VARCHAR)) AS batch_id, source_id, log_type, category,
      date_trunc('millisecond', coalesce(timestamp, TIMESTAMP '1970-01-01')) AS timestamp, nullif(trim(message), '') IS NULL AS blank_message, trace_id,
      coalesce(tag_count, -1) AS tag_count FROM dtos""",
)
def _(spark, sf):
    rows = dtos(spark, sf).withColumns(
        {
            "batch_id": F.concat(F.lit("batch-"), F.floor(F.col("event_id") / 100).cast("string")),
            "timestamp_unix_ms": F.coalesce(F.unix_millis(F.col("timestamp").cast("timestamp")), F.lit(0)),
            "trace_id": F.coalesce("trace_id", F.lit("")),
            "category": F.coalesce("category", F.lit(" ")),
            "tags": F.coalesce("tags", F.expr("CAST(map() AS map<string,string>)")),
        }
    )
    # A batch is a request of at most a hundred entries.
    batches = rows.groupBy("tenant_id", "batch_id").agg(
        F.collect_list(F.struct(*schema.BATCH_ENTRY.fieldNames())).alias("entries")
    )
    flat = from_batches(batches)
    return flat.select(
        "tenant_id", "batch_id", "source_id", "log_type", "category", "timestamp", C.is_blank(F.col("message")).alias("blank_message"), "trace_id",
        F.coalesce(F.size("tags"), F.lit(-1)).alias("tag_count"),
    )


@query(
    "s9_from_documents",
    DTOS + f"""SELECT event_id, coalesce(CASE WHEN lower(trim(level)) IN ('info', 'warn') THEN NULL ELSE {_CANON_LEVEL} END, 'Information') AS level,
      coalesce({_CANON}, 'Application') AS log_type, 'Push' AS ingestion_mode FROM dtos""",
)
def _(spark, sf):
    docs = dtos(spark, sf).withColumn("ingestion_mode", F.lit("carrier pigeon"))
    return I.from_documents(docs).select("event_id", "level", "log_type", "ingestion_mode")


# -- duplicates --------------------------------------------------------------------


@query(
    "w1_keep_first",
    DELIVERIES + """SELECT tenant_id, id, ingested_at, delivery, message FROM deliveries
    QUALIFY row_number() OVER (PARTITION BY tenant_id, id ORDER BY ingested_at, delivery) = 1""",
)
def _(spark, sf):
    return D.keep_first(deliveries(spark, sf), order=["ingested_at", "delivery"])


@query(
    "w3_latest_by_key",
    LOGS + """SELECT tenant_id, trace_id, id, timestamp, message FROM logs
    QUALIFY row_number() OVER (PARTITION BY tenant_id, trace_id ORDER BY timestamp DESC, id DESC) = 1""",
)
def _(spark, sf):
    rows = logs(spark, sf).select("tenant_id", "trace_id", "id", "timestamp", "message")
    return D.latest_by_key(rows, ["tenant_id", "trace_id"], ["timestamp", "id"])


@query(
    "w4_ttl_first_seen",
    DELIVERIES.replace("WITH", "WITH RECURSIVE", 1) + """, accepted AS (
      SELECT tenant_id, id, min((ingested_at, delivery)) AS a FROM deliveries GROUP BY 1, 2
      UNION ALL
      SELECT d.tenant_id, d.id, min((d.ingested_at, d.delivery)) FROM accepted p JOIN deliveries d ON d.tenant_id = p.tenant_id AND d.id = p.id
        AND d.ingested_at >= p.a[1] + INTERVAL 7 DAY GROUP BY 1, 2)
    SELECT tenant_id, id, a[1] AS ingested_at, a[2] AS delivery FROM accepted""",
)
def _(spark, sf):
    rows = D.mark_first_seen(deliveries(spark, sf), "7 DAYS", tie=["delivery"])
    return rows.filter("is_new").select("tenant_id", "id", "ingested_at", "delivery")




@query(
    "j2_drop_seen",
    LOGS + """, seen AS (SELECT tenant_id, id FROM logs WHERE log_type = 'Metric' AND timestamp + INTERVAL 20 DAY > TIMESTAMP '2024-01-31 00:00:00')
    SELECT l.tenant_id, l.id, l.message FROM logs l WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.tenant_id = l.tenant_id AND s.id = l.id)""",
)
def _(spark, sf):
    rows = logs(spark, sf)
    seen = rows.filter("log_type = 'Metric'").select(
        F.lit("storage").alias("sink"), "tenant_id", "id", (F.col("timestamp") + F.expr("INTERVAL 20 DAYS")).alias("expires_at")
    )
    return D.drop_seen(rows, seen, F.lit(AS_OF).cast("timestamp_ntz"), "storage").select("tenant_id", "id", "message")
