"""Row types of the data model and its fixed value sets."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the data model, in their canonical spelling and order.
LOG_TYPES = ["Application", "Error", "Network", "OS", "Metric", "Audit", "Custom"]
LEVELS = ["Trace", "Debug", "Information", "Warning", "Error", "Fatal"]
METRIC_TYPES = ["Counter", "Gauge", "Histogram", "Summary"]
INGESTION_MODES = ["Push", "Pull", "Replay"]
LEVEL_ALIASES = {"info": "Information", "warn": "Warning"}

# Limits of an incoming entry.
MAX_SOURCE_ID = 256
MAX_ENVIRONMENT = 64
MAX_MESSAGE = 65536
MAX_TAGS = 50
MAX_TAG_KEY = 128
MAX_TAG_VALUE = 1024
MAX_METRIC_NAME = 256
SOURCE_ID_PATTERN = r"^[a-zA-Z0-9\-_.:/]+$"

PARTITION_COLUMNS = ["tenant_id", "year", "month", "day", "hour"]

METRIC = T.StructType(
    [
        T.StructField("metric_name", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("metric_type", T.StringType()),
    ]
)

TAGS = T.MapType(T.StringType(), T.StringType())

# What a client sends. `id` is optional: a client id makes retries recognisable.
LOG_ENTRY_DTO = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("log_type", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("message", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("stack_trace", T.StringType()),
        T.StructField("tags", TAGS),
        T.StructField("metric", METRIC),
    ]
)

# An accepted entry, as archived.
LOG_ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("log_type", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("timestamp_unix_ms", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("stack_trace", T.StringType()),
        T.StructField("tags", TAGS),
        T.StructField("metric", METRIC),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("ingestion_mode", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
    ]
)

# Flat exchange form of an archived entry: 12 columns, tags as JSON text.
ARCHIVE_ROW = T.StructType(
    [
        T.StructField("Id", T.StringType()),
        T.StructField("SourceId", T.StringType()),
        T.StructField("LogType", T.StringType()),
        T.StructField("Level", T.StringType()),
        T.StructField("Environment", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("TimestampUnixMs", T.LongType()),
        T.StructField("Message", T.StringType()),
        T.StructField("TraceId", T.StringType()),
        T.StructField("TenantId", T.StringType()),
        T.StructField("SchemaVersion", T.IntegerType()),
        T.StructField("Tags", T.StringType()),
    ]
)

BATCH_ENTRY = T.StructType(
    [f for f in LOG_ENTRY_DTO.fields if f.name not in ("id", "timestamp")]
    + [T.StructField("timestamp_unix_ms", T.LongType())]
)
BATCH = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("entries", T.ArrayType(BATCH_ENTRY)),
    ]
)
