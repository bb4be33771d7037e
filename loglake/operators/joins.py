"""Lookups and correlations.

No join here carries a broadcast hint. Spark broadcasts a side whose measured size is below
`spark.sql.autoBroadcastJoinThreshold` and otherwise sort-merges, splitting skewed partitions (AQE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_HOT_DAYS = 7
DEFAULT_WARM_DAYS = 90


def _positive_or(col: Column, default: int) -> Column:
    return F.when(col > 0, col).otherwise(F.lit(default))


def with_tenant_settings(df: DataFrame, settings: DataFrame) -> DataFrame:
    """Add hot_days and warm_days; a missing row or a value that is not positive gives the default."""
    s = settings.select("tenant_id", "hot_retention_days", "warm_retention_days")
    return (
        df.join(s, "tenant_id", "left")
        .withColumns(
            {
                "hot_days": _positive_or(F.col("hot_retention_days"), DEFAULT_HOT_DAYS),
                "warm_days": _positive_or(F.col("warm_retention_days"), DEFAULT_WARM_DAYS),
            }
        )
        .drop("hot_retention_days", "warm_retention_days")
    )


def trace_spans(logs: DataFrame) -> DataFrame:
    """One row per trace: first and last time, rows, and the services it passed through.

    Rows are first reduced to one per trace and service, so a hot trace shrinks before it is grouped.
    """
    per_service = (
        logs.filter(F.col("trace_id").isNotNull())
        .groupBy("tenant_id", "trace_id", "source_id")
        .agg(
            F.min("timestamp").alias("t0"),
            F.max("timestamp").alias("t1"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.lower("level").isin("error", "fatal")).alias("errors"),
        )
    )
    return per_service.groupBy("tenant_id", "trace_id").agg(
        F.min("t0").alias("started_at"),
        F.max("t1").alias("ended_at"),
        F.sum("n").alias("entries"),
        F.sum("errors").alias("errors"),
        F.count(F.lit(1)).alias("services"),
        F.array_join(F.sort_array(F.collect_list("source_id")), ",").alias("service_list"),
    )


# Series a chart may have; more are no chart.
MAX_SERIES = 1000


def series_of(df: DataFrame, category: str, most: int = MAX_SERIES) -> list:
    """The distinct categories, null first; raises if there are more than ``most``, so the list is short by contract."""
    found = [r[0] for r in df.select(category).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} series")
    return sorted(found, key=lambda c: (c is not None, c))


def densify(df: DataFrame, label: str, category: str, value: str, series: list | None = None) -> DataFrame:
    """Every label with every category of `series` (the distinct ones, if not given), value 0 where there was no row.

    The input is one row per (label, category). Labels are made distinct, written once per category, and joined with
    their rows, so neither a label's cells nor the labels of a category meet in one place.
    """
    series = series_of(df, category) if series is None else series
    kind = df.schema[category].dataType
    every = F.explode(F.array(*(F.lit(c).cast(kind) for c in series)))
    cells = df.select(F.struct(F.col(label).alias("l"), F.col(category).alias("c")).alias("__cell"), F.col(value).alias("__v"))
    grid = df.select(label).distinct().select(label, every.alias(category))
    # Structs, unlike the columns themselves, are equal where both hold a null.
    named = grid.withColumn("__cell", F.struct(F.col(label).alias("l"), F.col(category).alias("c")))
    return named.join(cells, "__cell", "left").select(label, category, F.coalesce("__v", F.lit(0)).alias(value))


def reports_with_sql(reports: DataFrame, saved_queries: DataFrame) -> DataFrame:
    """Scheduled reports with the text of the saved query of the same tenant."""
    return reports.join(saved_queries.select("tenant_id", "query_id", "sql"), ["tenant_id", "query_id"])


def reconcile(archive: DataFrame, hot: DataFrame, by: list[str], tolerance_pct: float = 1.0) -> DataFrame:
    """Counts in both stores per group, and whether they agree within the tolerance."""
    a = archive.groupBy(*by).agg(F.count(F.lit(1)).alias("archived"))
    h = hot.groupBy(*by).agg(F.count(F.lit(1)).alias("indexed"))
    both = a.join(h, by, "full").fillna(0, ["archived", "indexed"])
    missing = F.col("archived") - F.col("indexed")
    pct = 100.0 * F.abs(missing) / F.greatest("archived", "indexed")
    return both.withColumns(
        {"difference": missing, "difference_pct": pct, "in_tolerance": pct <= tolerance_pct}
    )


def missing_ids(archive: DataFrame, hot: DataFrame) -> DataFrame:
    """Archived ids the hot store does not hold."""
    return archive.select("tenant_id", "id").distinct().join(hot.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti")
