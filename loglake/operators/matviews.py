"""Materialized views: definition, refresh, freshness, fallback, expiry and incremental upkeep."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions.columns import interval, ts_lit
from loglake.operators import aggregates as A
from loglake.operators.filters import time_range
from loglake.operators.user_sql import run_query
from loglake.sinks.tables import delete_path
from loglake.sources.files import path_exists, tenant_folder

_TENANT = ("tenant_id",)


@dataclass(frozen=True)
class View:
    """A named aggregation over `logs`, computed for all tenants at once (`tenant_id` is a key)."""

    name: str
    build: Callable[..., DataFrame]  # (logs, as_of, look_back) -> rows
    bucket: str
    look_back: str
    refresh_seconds: int
    retention_minutes: int
    sums: list[str] = field(default_factory=list)  # measures that add up when buckets are merged


STANDARD_VIEWS = {
    v.name: v
    for v in [
        View(
            "error_rate_per_minute",
            lambda logs, as_of, back: A.error_rate_per_minute(logs, as_of, back, _TENANT),
            "minute_bucket", "2 MINUTES", 60, 1440, ["error_count"],
        ),
        View(
            "latency_p99_per_service",
            lambda logs, as_of, back: A.latency_percentiles(logs, as_of, back, _TENANT),
            "bucket", "10 MINUTES", 300, 2880,
        ),
        View(
            "log_volume_by_type",
            lambda logs, as_of, back: A.log_volume_by_type(logs, as_of, back, _TENANT),
            "minute_bucket", "2 MINUTES", 60, 1440, ["entry_count"],
        ),
    ]
}


def define_view(
    name: str,
    sql: str,
    bucket: str,
    look_back: str = "7 DAYS",
    refresh_seconds: int = 300,
    retention_minutes: int = 1440,
    sums: list[str] | None = None,
) -> View:
    """A user's view as SQL over `{logs}` (or `logs`), which must keep tenant_id as a key, and over nothing else."""

    def build(logs: DataFrame, as_of, back: str) -> DataFrame:
        recent = logs.filter(F.col("timestamp") >= ts_lit(logs, as_of) - interval(back))
        return run_query(logs.sparkSession, sql.replace("{logs}", "logs"), {"logs": recent})

    return View(name, build, bucket, look_back, refresh_seconds, retention_minutes, sums or [])


def refresh_view(logs: DataFrame, view: View, as_of: dt.datetime | str, look_back: str | None = None) -> DataFrame:
    """The view's rows for every tenant, stamped with the refresh time."""
    rows = view.build(logs, as_of, look_back or view.look_back)
    return rows.withColumn("refreshed_at", ts_lit(logs, as_of))


def refresh_views(
    logs: DataFrame, views: dict[str, View], as_of: dt.datetime | str, tenant: str | None = None, look_back: str | None = None
) -> dict[str, DataFrame]:
    scoped = logs if tenant is None else logs.filter(F.col("tenant_id") == tenant)
    return {name: refresh_view(scoped, view, as_of, look_back) for name, view in views.items()}


def write_view(rows: DataFrame, root: str, name: str, tenant: str | None = None) -> None:
    """Replace the refreshed tenants' partitions of a stored view.

    A refresh of one `tenant` leaves the others as they are. A refresh of all of them leaves nothing behind of a
    tenant that has no rows any more.
    """
    spark, path = rows.sparkSession, f"{root}/{name}"
    silent = []
    if path_exists(spark, path):
        kept = spark.read.parquet(path).select("tenant_id").distinct()
        kept = kept if tenant is None else kept.filter(F.col("tenant_id") == tenant)
        silent = kept.join(rows.select("tenant_id").distinct(), "tenant_id", "left_anti").collect()
    (
        rows.hint("rebalance", "tenant_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("tenant_id")
        .parquet(path)
    )
    for row in silent:
        delete_path(spark, f"{path}/{tenant_folder(spark, row.tenant_id)}")


def read_view(
    spark: SparkSession, root: str, view: View, tenant: str | None, as_of, t_from=None, t_to=None
) -> DataFrame | None:
    """Stored rows of a tenant and bucket range with `freshness_seconds` and `source`; None if never stored."""
    if not path_exists(spark, f"{root}/{view.name}"):
        return None
    rows = spark.read.parquet(f"{root}/{view.name}")
    if tenant is not None:
        rows = rows.filter(F.col("tenant_id") == tenant)
    rows = time_range(rows, t_from, t_to, col=view.bucket)
    fresh = F.timestamp_diff("SECOND", F.col("refreshed_at"), ts_lit(rows, as_of, "refreshed_at"))
    return rows.withColumns({"freshness_seconds": fresh, "source": F.lit(f"matview:{view.name}")})


def view_status(meta: DataFrame, as_of: dt.datetime | str) -> DataFrame:
    """Health of views from (view_name, tenant_id, refreshed_at, refresh_seconds)."""
    age = F.timestamp_diff("SECOND", F.col("refreshed_at"), ts_lit(meta, as_of, "refreshed_at"))
    every = F.col("refresh_seconds")
    status = F.when(age.isNull(), "Missing").when(age >= 2 * every, "Stale").otherwise("Healthy")
    return meta.withColumns(
        {
            "freshness_seconds": age,
            "status": status,
            "use_live": age.isNull() | (age >= 4 * every),
            "next_refresh_at": F.col("refreshed_at") + F.expr("INTERVAL 1 SECOND") * every,
        }
    )


def view_or_live(
    spark: SparkSession, root: str, view: View, logs: DataFrame, tenant: str, as_of, look_back: str | None = None
) -> DataFrame:
    """Stored rows, or the live query when the view is missing or four intervals old (`is_fallback`)."""
    stored = read_view(spark, root, view, tenant, as_of)
    if stored is not None:
        state = stored.agg(F.max("refreshed_at").alias("refreshed_at")).withColumn(
            "refresh_seconds", F.lit(view.refresh_seconds)
        )
        if not view_status(state, as_of).first()["use_live"]:
            return stored.drop("freshness_seconds", "source").withColumn("is_fallback", F.lit(False))
    live = refresh_view(logs.filter(F.col("tenant_id") == tenant), view, as_of, look_back)
    return live.withColumn("is_fallback", F.lit(True))


def expire_view(rows: DataFrame, view: View, as_of: dt.datetime | str) -> DataFrame:
    """Rows whose refresh is within the view's retention."""
    limit = ts_lit(rows, as_of, "refreshed_at") - interval(f"{view.retention_minutes} MINUTES")
    return rows.filter(F.col("refreshed_at") > limit)


def expire_stored(spark: SparkSession, root: str, view: View, as_of: dt.datetime | str) -> list[str]:
    """Delete the tenants' partitions of a stored view whose last refresh is past its retention; returns the tenants."""
    rows = spark.read.parquet(f"{root}/{view.name}")
    last = rows.groupBy("tenant_id").agg(F.max("refreshed_at").alias("refreshed_at"))
    gone = [r.tenant_id for r in last.join(expire_view(last, view, as_of), "tenant_id", "left_anti").collect()]
    for tenant in gone:
        delete_path(spark, f"{root}/{view.name}/{tenant_folder(spark, tenant)}")
    return gone


def merge_batch(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Counts kept per `batch_id`: a batch that comes again takes the place of its first try. Sum them with
    `merge_counts`, or `total_counts`, when they are read."""
    return stored.join(fresh.select("batch_id").distinct(), "batch_id", "left_anti").select(*stored.columns).unionByName(fresh)


def total_counts(rows: DataFrame, view: View) -> DataFrame:
    """One row per bucket of counts kept per batch."""
    return merge_counts(rows.drop("batch_id"), rows.drop("batch_id").limit(0), view)


def merge_counts(stored: DataFrame, fresh: DataFrame, view: View) -> DataFrame:
    """Add newly counted rows to stored buckets. For views whose measures are sums."""
    keys = [c for c in stored.columns if c not in [*view.sums, "refreshed_at"]]
    both = stored.unionByName(fresh)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in view.sums], F.max("refreshed_at").alias("refreshed_at"))


def refresh_touched(stored: DataFrame, logs: DataFrame, fresh_logs: DataFrame, view: View, as_of, width: str) -> DataFrame:
    """Recompute only the buckets that new rows fall into; for percentiles, which do not add up.

    `logs` holds old and new rows. The span of the new rows bounds the scan before the buckets are
    matched, so untouched history is not read.
    """
    bucket = F.window("timestamp", width)["start"]
    touched = fresh_logs.select("tenant_id", bucket.alias("__b")).distinct()
    span = touched.agg(F.struct(F.min("__b").alias("lo"), F.max("__b").alias("hi"))).scalar()
    affected = (
        logs.filter((F.col("timestamp") >= span["lo"]) & (F.col("timestamp") < span["hi"] + interval(width)))
        .withColumn("__b", bucket)
        .join(touched, ["tenant_id", "__b"], "left_semi")
        .drop("__b")
    )
    recomputed = refresh_view(affected, view, as_of, "1000 YEARS")
    kept = stored.join(touched.withColumnRenamed("__b", view.bucket), ["tenant_id", view.bucket], "left_anti")
    return kept.unionByName(recomputed)


# Items a quantile sketch keeps on its lowest level; exact up to there.
SKETCH_K = 800


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """The rank error of a KLL sketch with ``k`` items, for one quantile and 99 % of sketches: 2.446 / k^0.943."""
    return 2.446 / k**0.9433


def latency_sketches(logs: DataFrame, width: str = "5 minutes", k: int = SKETCH_K) -> DataFrame:
    """One quantile sketch per tenant, bucket and service of the latency rows, and how many went in.

    Sketches add up: those of old and new rows of a bucket are merged without reading either again, and buckets may
    be rolled up to longer ones.
    """
    rows = logs.filter((F.col("log_type") == "Metric") & (F.col("category") == "http-latency") & F.col("metric_value").isNotNull())
    start = F.window("timestamp", width)["start"]
    return rows.groupBy("tenant_id", start.alias("bucket"), F.col("source_id").alias("service")).agg(
        F.kll_sketch_agg_double("metric_value", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("entries")
    )


def merge_sketches(stored: DataFrame, fresh: DataFrame | None = None, bucket: Column | None = None, k: int = SKETCH_K) -> DataFrame:
    """Sketches of the same bucket as one; with ``bucket``, an expression over `bucket`, of the longer buckets it names."""
    both = stored if fresh is None else stored.unionByName(fresh)
    target = (F.col("bucket") if bucket is None else bucket).alias("bucket")
    return both.groupBy("tenant_id", target, "service").agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("entries").alias("entries")
    )


def sketch_percentiles(sketches: DataFrame, quantiles: tuple[float, ...] = A.QUANTILES) -> DataFrame:
    """p50_ms, p95_ms, … of sketches: values whose rank is right up to `sketch_rank_error`."""
    names = [f"p{q * 100:g}_ms" for q in quantiles]
    values = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(n) for q, n in zip(quantiles, names)]
    return sketches.select("tenant_id", "bucket", "service", *values, "entries")


def write_sketches(sketches: DataFrame, root: str, batch_id: int) -> None:
    """Keep a batch's sketches, by day of the bucket; a repeated batch takes the place of its first try. Nothing stored is
    read: untouched buckets cost nothing."""
    rows = sketches.withColumns({"day": F.to_date("bucket"), "batch_id": F.lit(batch_id)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(root)


def read_percentiles(spark: SparkSession, root: str, t_from=None, t_to=None, bucket: Column | None = None) -> DataFrame:
    """The latency view from stored sketches; only the days of the range are opened."""
    rows = time_range(spark.read.parquet(root), t_from, t_to, col="bucket")
    if t_from is not None:
        rows = rows.filter(F.col("day") >= F.to_date(F.lit(str(t_from))))
    if t_to is not None:
        rows = rows.filter(F.col("day") <= F.to_date(F.lit(str(t_to))))
    return sketch_percentiles(merge_sketches(rows, bucket=bucket))
