"""The canonical `logs` view: one column dialect over everything that holds log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.functions.columns import level_ord, partition_parts


def canonical_logs(entries: DataFrame) -> DataFrame:
    """Add the derived columns queries use. Columns that are already there stay as they are.

    Nothing here costs anything unless a query selects it: Catalyst prunes unused projections.
    """
    df = entries
    have = set(df.columns)

    def add(name, expr):
        nonlocal df
        if name not in have:
            df = df.withColumn(name, expr)

    add("timestamp", F.timestamp_millis("timestamp_unix_ms"))
    derived = {
        "service": F.col("source_id"),
        "metric_value": F.col("metric.value"),
        "duration_ms": F.try_element_at("tags", F.lit("duration_ms")).try_cast("double"),
        "status_code": F.try_element_at("tags", F.lit("status_code")).try_cast("int"),
        "endpoint": F.try_element_at("tags", F.lit("endpoint")),
        "level_ord": level_ord(F.col("level")),
        **partition_parts(F.col("timestamp")),
        "hour_of_day": F.hour("timestamp"),
        "day_of_week": F.dayofweek("timestamp") - 1,
        "sourceid": F.col("source_id"),
        "logtype": F.col("log_type"),
        "tenantid": F.col("tenant_id"),
        "traceid": F.col("trace_id"),
    }
    return df.withColumns({k: v for k, v in derived.items() if k not in have})
