"""Batches from the ingest interface, and the state of time-based pulls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.columns import blank_to_null, ts_lit


def from_batches(batches: DataFrame) -> DataFrame:
    """One row per entry of (tenant_id, batch_id, entries).

    Unary and per-message streams are one batch each; a client stream is several batches with one id.
    """
    rows = batches.select("tenant_id", "batch_id", F.explode("entries").alias("e"))
    c = F.col
    return rows.select(
        "tenant_id",
        "batch_id",
        c("e.source_id").alias("source_id"),
        c("e.log_type").alias("log_type"),
        c("e.level").alias("level"),
        c("e.environment").alias("environment"),
        blank_to_null(c("e.category")).alias("category"),
        F.timestamp_millis(c("e.timestamp_unix_ms")).alias("timestamp"),
        c("e.message").alias("message"),
        blank_to_null(c("e.trace_id")).alias("trace_id"),
        blank_to_null(c("e.stack_trace")).alias("stack_trace"),
        F.when(F.size(F.map_keys("e.tags")) > 0, c("e.tags")).alias("tags"),
        c("e.metric").alias("metric"),
    )


def pull_state_since(last_event: Column, last_pull: Column, last_run: Column, as_of: Column) -> Column:
    """Where a pull job resumes: saved event time, saved pull time, last run, or an hour ago."""
    return F.coalesce(last_event, last_pull, last_run, as_of - F.expr("INTERVAL 1 HOUR"))


def pull_since(df: DataFrame, since: dt.datetime | str, col: str = "timestamp") -> DataFrame:
    return df.filter(F.col(col) > ts_lit(df, since, col))


def next_since(df: DataFrame, *by: str, col: str = "timestamp") -> DataFrame:
    """The state to save after a pull: the newest event time."""
    return df.groupBy(*by).agg(F.max(col).alias("last_event_timestamp"))
