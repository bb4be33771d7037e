"""Validation, normalisation and the row forms an entry takes on its way in and out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake import schema
from loglake.functions.columns import (
    as_instant,
    blank_to_null,
    canon_enum,
    error_list,
    is_blank,
    partition_parts,
    ts_lit,
    uuid7,
)


def _entry_checks(df: DataFrame, as_of: dt.datetime | str) -> Column:
    c = F.col
    now = ts_lit(df, as_of)
    is_metric = F.lower("log_type") == "metric"
    return error_list(
        (is_blank(c("source_id")), "source_id is empty"),
        (F.length("source_id") > schema.MAX_SOURCE_ID, "source_id is too long"),
        (~F.coalesce(c("source_id"), F.lit("")).rlike(schema.SOURCE_ID_PATTERN), "source_id has invalid characters"),
        (is_blank(c("log_type")), "log_type is empty"),
        (canon_enum(c("log_type"), schema.LOG_TYPES).isNull(), "log_type is unknown"),
        (is_blank(c("level")), "level is empty"),
        (canon_enum(c("level"), schema.LEVELS).isNull(), "level is unknown"),
        (is_blank(c("environment")), "environment is empty"),
        (F.length("environment") > schema.MAX_ENVIRONMENT, "environment is too long"),
        (c("timestamp").isNull(), "timestamp is empty"),
        (c("timestamp") > now + F.expr("INTERVAL 5 MINUTES"), "timestamp is in the future"),
        (c("timestamp") <= now - F.expr("INTERVAL 30 DAYS"), "timestamp is too old"),
        (is_blank(c("message")), "message is empty"),
        (F.length("message") > schema.MAX_MESSAGE, "message is too long"),
        (F.size(F.map_keys("tags")) > schema.MAX_TAGS, "too many tags"),
        (F.exists(F.map_keys("tags"), lambda k: F.length(k) > schema.MAX_TAG_KEY), "tag key is too long"),
        (F.exists(F.map_values("tags"), lambda v: F.length(v) > schema.MAX_TAG_VALUE), "tag value is too long"),
        (is_metric & c("metric").isNull(), "metric is missing"),
        (is_metric & c("metric").isNotNull() & is_blank(c("metric.metric_name")), "metric name is empty"),
        (is_metric & (F.length("metric.metric_name") > schema.MAX_METRIC_NAME), "metric name is too long"),
        (is_metric & c("metric").isNotNull() & is_blank(c("metric.unit")), "metric unit is empty"),
    )


def validate_entries(dtos: DataFrame, as_of: dt.datetime | str) -> DataFrame:
    """Add `errors` (every broken rule) and `is_valid`."""
    return dtos.withColumn("errors", _entry_checks(dtos, as_of)).withColumn(
        "is_valid", F.size("errors") == 0
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Both read the same projection; persist it if both are written."""
    accepted = validated.filter("is_valid").drop("errors", "is_valid")
    return accepted, validated.filter("NOT is_valid")


def ingest_summary(validated: DataFrame, *by: str) -> DataFrame:
    return validated.groupBy(*by).agg(
        F.count_if(F.col("is_valid")).alias("accepted"),
        F.count_if(~F.col("is_valid")).alias("rejected"),
    )


def canonical_enums(df: DataFrame) -> DataFrame:
    """Canonical spelling of log type and level; the short names Info and Warn are taken too."""
    return df.withColumns(
        {
            "log_type": canon_enum(F.col("log_type"), schema.LOG_TYPES),
            "level": canon_enum(F.col("level"), schema.LEVELS, schema.LEVEL_ALIASES),
        }
    )


def to_entries(dtos: DataFrame, tenant: str | Column, mode: str, ingested_at: dt.datetime | str | Column) -> DataFrame:
    """Accepted input rows to entries. Tenant, ingest time and mode never come from the client."""
    c = F.col
    tenant_col = tenant if isinstance(tenant, Column) else F.lit(tenant)
    at = ingested_at if isinstance(ingested_at, Column) else F.lit(str(ingested_at)).cast("timestamp")
    millis = F.unix_millis(as_instant(c("timestamp")))
    metric = F.when(
        c("metric").isNotNull(),
        F.struct(
            c("metric.metric_name").alias("metric_name"),
            c("metric.unit").alias("unit"),
            c("metric.value").alias("value"),
            canon_enum(c("metric.metric_type"), schema.METRIC_TYPES).alias("metric_type"),
        ),
    )
    generated = uuid7(
        millis, tenant_col,
        *(c(n) for n in ("source_id", "log_type", "level", "environment", "category", "message", "trace_id", "stack_trace")),
        F.to_json(F.array_sort(F.map_entries("tags"))), F.to_json("metric"),
    )
    entry_id = F.coalesce(c("id"), generated) if "id" in dtos.columns else generated
    return dtos.select(
        entry_id.alias("id"),
        "source_id",
        canon_enum(c("log_type"), schema.LOG_TYPES).alias("log_type"),
        canon_enum(c("level"), schema.LEVELS, schema.LEVEL_ALIASES).alias("level"),
        "environment",
        "category",
        millis.alias("timestamp_unix_ms"),
        "message",
        "trace_id",
        "stack_trace",
        F.coalesce(c("tags"), F.expr("CAST(map() AS map<string,string>)")).alias("tags"),
        metric.alias("metric"),
        tenant_col.alias("tenant_id"),
        at.alias("ingested_at"),
        F.lit(mode).alias("ingestion_mode"),
        F.lit(1).alias("schema_version"),
    )


def to_dtos(entries: DataFrame) -> DataFrame:
    """The client-visible part of an entry; system fields are dropped."""
    return entries.select(
        "source_id",
        "log_type",
        "level",
        "environment",
        "category",
        F.timestamp_millis("timestamp_unix_ms").alias("timestamp"),
        "message",
        "trace_id",
        "stack_trace",
        "tags",
        "metric",
    )


def to_archive_rows(entries: DataFrame) -> DataFrame:
    """The flat 12-column exchange form."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    return entries.select(
        F.col("id").alias("Id"),
        F.col("source_id").alias("SourceId"),
        F.col("log_type").alias("LogType"),
        F.col("level").alias("Level"),
        F.col("environment").alias("Environment"),
        text("category").alias("Category"),
        F.col("timestamp_unix_ms").alias("TimestampUnixMs"),
        F.col("message").alias("Message"),
        text("trace_id").alias("TraceId"),
        F.col("tenant_id").alias("TenantId"),
        F.col("schema_version").cast("int").alias("SchemaVersion"),
        F.coalesce(F.to_json("tags"), F.lit("{}")).alias("Tags"),
    )


def from_archive_rows(rows: DataFrame, fallback_tenant: str, ingested_at: dt.datetime | str) -> DataFrame:
    """Entries from the flat form, with defaults for what cannot be read."""
    c = F.col
    return rows.select(
        c("Id").alias("id"),
        c("SourceId").alias("source_id"),
        F.coalesce(canon_enum(c("LogType"), schema.LOG_TYPES), F.lit("Application")).alias("log_type"),
        F.coalesce(canon_enum(c("Level"), schema.LEVELS), F.lit("Information")).alias("level"),
        c("Environment").alias("environment"),
        blank_to_null(c("Category")).alias("category"),
        c("TimestampUnixMs").alias("timestamp_unix_ms"),
        c("Message").alias("message"),
        blank_to_null(c("TraceId")).alias("trace_id"),
        F.lit(None).cast("string").alias("stack_trace"),
        F.from_json(blank_to_null(c("Tags")), schema.TAGS).alias("tags"),
        F.lit(None).cast(schema.METRIC).alias("metric"),
        F.coalesce(blank_to_null(c("TenantId")), F.lit(fallback_tenant)).alias("tenant_id"),
        F.lit(str(ingested_at)).cast("timestamp").alias("ingested_at"),
        F.lit("Replay").alias("ingestion_mode"),
        c("SchemaVersion").alias("schema_version"),
    )


def with_partitions(entries: DataFrame) -> DataFrame:
    """Partition strings of the UTC event time, and the path they make."""
    if "timestamp" not in entries.columns:
        entries = entries.withColumn("timestamp", F.timestamp_millis("timestamp_unix_ms"))
    df = entries.withColumns(partition_parts(F.col("timestamp")))
    return df.withColumn("partition_path", F.concat_ws("/", *schema.PARTITION_COLUMNS))


def to_documents(entries: DataFrame) -> DataFrame:
    """The 16 fields a search document holds."""
    return entries.select(
        "id",
        "tenant_id",
        "message",
        "category",
        "level",
        "log_type",
        "timestamp_unix_ms",
        F.timestamp_millis("timestamp_unix_ms").alias("timestamp"),
        "source_id",
        "environment",
        "trace_id",
        "stack_trace",
        "tags",
        "ingested_at",
        "ingestion_mode",
        "schema_version",
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """Entries from search documents; unreadable enum values fall back to their defaults."""
    c = F.col
    fallback = {
        "level": F.coalesce(canon_enum(c("level"), schema.LEVELS), F.lit("Information")),
        "log_type": F.coalesce(canon_enum(c("log_type"), schema.LOG_TYPES), F.lit("Application")),
        "ingestion_mode": F.coalesce(canon_enum(c("ingestion_mode"), schema.INGESTION_MODES), F.lit("Push")),
    }
    return docs.withColumns(fallback).drop("timestamp")


def typed_tags(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Tags as typed columns: ``{"http_status": "int"}``; values that do not convert become NULL."""
    return df.withColumns(
        {name: F.try_element_at("tags", F.lit(name)).try_cast(kind) for name, kind in fields.items()}
    )
