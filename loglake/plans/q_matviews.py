"""Queries M1–M7: materialized views."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.operators import matviews as M
from loglake.plans.fixtures import AS_OF, LOGS, logs
from loglake.plans.registry import query
from loglake.session import new_path

_ALL = "31 DAYS"
_ERRORS = f"""SELECT tenant_id, date_trunc('minute', timestamp) AS minute_bucket, source_id AS service, count(*) AS error_count
  FROM logs WHERE log_type = 'Error' AND level IN ('Error', 'Fatal') GROUP BY 1, 2, 3"""
_LATENCY = """SELECT tenant_id, time_bucket(INTERVAL 5 MINUTE, timestamp) AS bucket, source_id AS service, quantile_disc(metric_value, 0.5) AS p50_ms,
  quantile_disc(metric_value, 0.95) AS p95_ms, quantile_disc(metric_value, 0.99) AS p99_ms FROM logs WHERE log_type = 'Metric' AND category = 'http-latency' GROUP BY 1, 2, 3"""


def _error_view():
    return M.STANDARD_VIEWS["error_rate_per_minute"]


def _stored(spark, sf, name="error_rate_per_minute", tenant=None):
    root = new_path(spark, "views")
    rows = M.refresh_views(logs(spark, sf), {name: M.STANDARD_VIEWS[name]}, AS_OF, tenant, _ALL)[name]
    M.write_view(rows, root, name)
    return root


@query(
    "m1_refresh_views",
    LOGS + f""", e AS ({_ERRORS}), l AS ({_LATENCY}), v AS (SELECT tenant_id, date_trunc('minute', timestamp) AS b, log_type, count(*) AS n FROM logs GROUP BY 1, 2, 3)
    SELECT 'error_rate_per_minute' AS view_name, tenant_id, count(*) AS stored_rows, sum(error_count)::BIGINT AS measured FROM e GROUP BY 2
    UNION ALL SELECT 'latency_p99_per_service', tenant_id, count(*), count(p99_ms) FROM l GROUP BY 2
    UNION ALL SELECT 'log_volume_by_type', tenant_id, count(*), sum(n)::BIGINT FROM v GROUP BY 2""",
)
def _(spark, sf):
    root = new_path(spark, "views")
    out = None
    measured = {"error_rate_per_minute": F.sum("error_count"), "latency_p99_per_service": F.count("p99_ms"), "log_volume_by_type": F.sum("entry_count")}
    for name, rows in M.refresh_views(logs(spark, sf), M.STANDARD_VIEWS, AS_OF, look_back=_ALL).items():
        M.write_view(rows, root, name)
        stored = spark.read.parquet(f"{root}/{name}").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("stored_rows"), measured[name].alias("measured"))
        stored = stored.withColumn("view_name", F.lit(name))
        out = stored if out is None else out.unionByName(stored)
    return out


@query(
    "m2_read_view",
    LOGS + f""", e AS ({_ERRORS}) SELECT tenant_id, minute_bucket, service, error_count, TIMESTAMP '{AS_OF}' AS refreshed_at, 135 AS freshness_seconds,
      'matview:error_rate_per_minute' AS source FROM e WHERE tenant_id = 'tenant-1' AND minute_bucket >= TIMESTAMP '2024-01-10' AND minute_bucket < TIMESTAMP '2024-01-20'""",
)
def _(spark, sf):
    root = _stored(spark, sf)
    return M.read_view(spark, root, _error_view(), "tenant-1", "2024-01-31 00:02:15", "2024-01-10", "2024-01-20")


@query(
    "m3_view_status",
    LOGS + f""", meta AS (SELECT tenant_id, endpoint AS view_name, CASE WHEN endpoint LIKE '%signup%' THEN NULL ELSE max(timestamp) END AS refreshed_at, 3600 AS refresh_seconds FROM logs GROUP BY 1, 2),
    aged AS (SELECT *, date_diff('microsecond', refreshed_at, TIMESTAMP '{AS_OF}') // 1000000 AS freshness_seconds FROM meta)
    SELECT view_name, tenant_id, refreshed_at, refresh_seconds, freshness_seconds,
      CASE WHEN freshness_seconds IS NULL THEN 'Missing' WHEN freshness_seconds >= 7200 THEN 'Stale' ELSE 'Healthy' END AS status,
      freshness_seconds IS NULL OR freshness_seconds >= 14400 AS use_live, refreshed_at + INTERVAL 3600 SECOND AS next_refresh_at FROM aged""",
)
def _(spark, sf):
    newest = F.max("timestamp")
    meta = logs(spark, sf).groupBy("tenant_id", F.col("endpoint").alias("view_name")).agg(newest.alias("n")).select(
        "view_name", "tenant_id", F.when(~F.col("view_name").contains("signup"), F.col("n")).alias("refreshed_at"), F.lit(3600).alias("refresh_seconds")
    )
    return M.view_status(meta, AS_OF)


@query(
    "m4_view_or_live",
    LOGS + f""", e AS ({_ERRORS}) SELECT 'fresh' AS case_, minute_bucket, service, error_count, false AS is_fallback FROM e WHERE tenant_id = 'tenant-1'
    UNION ALL SELECT 'stale', minute_bucket, service, error_count, true FROM e WHERE tenant_id = 'tenant-1'
    UNION ALL SELECT 'missing', minute_bucket, service, error_count, true FROM e WHERE tenant_id = 'tenant-1'""",
)
def _(spark, sf):
    root, view, rows = _stored(spark, sf), _error_view(), logs(spark, sf)
    out = None
    for case, where, as_of in (
        ("fresh", root, "2024-01-31 00:03:59"), ("stale", root, "2024-01-31 00:04:00"), ("missing", root + "-none", AS_OF),
    ):
        part = M.view_or_live(spark, where, view, rows, "tenant-1", as_of, "40 DAYS").withColumn("case_", F.lit(case))
        part = part.select("case_", "minute_bucket", "service", "error_count", "is_fallback")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "m5_expire_view",
    LOGS + f""", e AS ({_ERRORS}) SELECT tenant_id, minute_bucket, service, error_count FROM e
    WHERE minute_bucket + INTERVAL 1 MINUTE > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1440 MINUTE""",
)
def _(spark, sf):
    view = _error_view()
    rows = M.refresh_view(logs(spark, sf), view, AS_OF, _ALL).withColumn("refreshed_at", F.col("minute_bucket") + F.expr("INTERVAL 1 MINUTE"))
    return M.expire_view(rows, view, "2024-01-20 00:00:00").drop("refreshed_at")


@query(
    "m6_custom_view",
    LOGS + f"""SELECT tenant_id, date_trunc('hour', timestamp) AS hour_bucket, tag_http_status AS status, count(*) AS request_count, TIMESTAMP '{AS_OF}' AS refreshed_at
    FROM logs WHERE category = 'http-request' GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    view = M.define_view(
        "http_status_per_hour",
        """SELECT tenant_id, CAST(date_trunc('hour', timestamp) AS TIMESTAMP_NTZ) AS hour_bucket, tags['http_status'] AS status, count(*) AS request_count
        FROM {logs} WHERE category = 'http-request' GROUP BY ALL""",
        "hour_bucket", _ALL, 300, 10080, ["request_count"],
    )
    return M.refresh_view(logs(spark, sf), view, AS_OF)


_CUT = "2024-01-17 11:22:33"


def _before_after(spark, sf):
    rows = logs(spark, sf)
    cut = F.lit(_CUT).cast("timestamp_ntz")
    return rows, rows.filter(F.col("timestamp") < cut), rows.filter(F.col("timestamp") >= cut)


@query("m7_merge_counts", LOGS + _ERRORS)
def _(spark, sf):
    _, old, new = _before_after(spark, sf)
    view = _error_view()
    merged = M.merge_counts(M.refresh_view(old, view, _CUT, _ALL), M.refresh_view(new, view, AS_OF, _ALL), view)
    return merged.drop("refreshed_at")


@query("m7_merge_batches", LOGS + _ERRORS)
def _(spark, sf):
    """The second batch comes twice."""
    _, old, new = _before_after(spark, sf)
    view = _error_view()
    first = M.refresh_view(old, view, _CUT, _ALL).withColumn("batch_id", F.lit(1))
    second = M.refresh_view(new, view, AS_OF, _ALL).withColumn("batch_id", F.lit(2))
    kept = M.merge_batch(M.merge_batch(first, second), second)
    return M.total_counts(kept, view).drop("refreshed_at")


@query(
    "m1_silent_tenant",
    LOGS + f""", e AS ({_ERRORS}) SELECT tenant_id, minute_bucket, service, error_count FROM e WHERE tenant_id <> 'tenant-2'""",
)
def _(spark, sf):
    """After a refresh in which a tenant had no rows, none of its old rows are served."""
    root, view, rows = new_path(spark, "views"), _error_view(), logs(spark, sf)
    M.write_view(M.refresh_view(rows, view, AS_OF, _ALL), root, view.name)
    M.write_view(M.refresh_view(rows.filter("tenant_id <> 'tenant-2'"), view, AS_OF, _ALL), root, view.name)
    return spark.read.parquet(f"{root}/{view.name}").select("tenant_id", "minute_bucket", "service", "error_count")


@query(
    "m5_expire_stored",
    LOGS + f""", e AS ({_ERRORS}) SELECT tenant_id, minute_bucket, service, error_count FROM e WHERE tenant_id IN ('tenant-0', 'tenant-1')""",
)
def _(spark, sf):
    root, view = new_path(spark, "views"), _error_view()
    late = F.when(F.col("tenant_id").isin("tenant-0", "tenant-1"), F.lit("2024-01-30 12:00:00")).otherwise("2024-01-01 00:00:00")
    rows = M.refresh_view(logs(spark, sf), view, AS_OF, _ALL).withColumn("refreshed_at", late.cast("timestamp_ntz"))
    M.write_view(rows, root, view.name)
    M.expire_stored(spark, root, view, "2024-01-31 00:00:00")
    return spark.read.parquet(f"{root}/{view.name}").select("tenant_id", "minute_bucket", "service", "error_count")


@query("m7_refresh_touched", LOGS + _LATENCY)
def _(spark, sf):
    rows, old, new = _before_after(spark, sf)
    view = M.STANDARD_VIEWS["latency_p99_per_service"]
    stored = M.refresh_view(old, view, _CUT, _ALL)
    return M.refresh_touched(stored, rows, new, view, AS_OF, "5 minutes").drop("refreshed_at")


_SKETCHED = """SELECT tenant_id, time_bucket(INTERVAL {width}, timestamp) AS bucket, source_id AS service, quantile_disc(metric_value, 0.5) AS p50_ms,
  quantile_disc(metric_value, 0.95) AS p95_ms, quantile_disc(metric_value, 0.99) AS p99_ms, count(*) AS entries FROM logs
  WHERE log_type = 'Metric' AND category = 'http-latency' GROUP BY 1, 2, 3"""


def _sketches(spark, sf):
    """Two batches, the second of which comes twice."""
    root = new_path(spark, "sketches")
    _, old, new = _before_after(spark, sf)
    for batch_id, rows in ((1, old), (2, new), (2, new)):
        M.write_sketches(M.latency_sketches(rows), root, batch_id)
    return root


@query("m7_merge_sketches", LOGS + _SKETCHED.format(width="5 MINUTE"))
def _(spark, sf):
    """Buckets are smaller than a sketch, so their percentiles are exact."""
    return M.read_percentiles(spark, _sketches(spark, sf))


@query(
    "a2_percentiles_from_sketches",
    LOGS + ", s AS (" + _SKETCHED.format(width="1 DAY") + ") SELECT tenant_id, bucket, service, entries, true AS within_error FROM s WHERE bucket >= TIMESTAMP '2024-01-08' AND bucket < TIMESTAMP '2024-01-22'",
)
def _(spark, sf):
    """Five-minute sketches rolled up to days; the ranks of the values they give are within the stated error."""
    day = F.date_trunc("day", "bucket")
    rolled = M.read_percentiles(spark, _sketches(spark, sf), "2024-01-08 00:00:00", "2024-01-22 00:00:00", day)
    rows = logs(spark, sf).filter("log_type = 'Metric' AND category = 'http-latency'")
    own = rows.select("tenant_id", F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("bucket"), F.col("source_id").alias("service"), "metric_value")
    both = own.join(rolled.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")), ["tenant_id", "bucket", "service"])
    below = [F.avg((F.col("metric_value") < F.col(f"p{q}_ms")).cast("int")) for q in (50, 95, 99)]
    upto = [F.avg((F.col("metric_value") <= F.col(f"p{q}_ms")).cast("int")) for q in (50, 95, 99)]
    e = M.sketch_rank_error()
    fits = [(lo <= q / 100 + e) & (hi >= q / 100 - e) for lo, hi, q in zip(below, upto, (50, 95, 99))]
    return both.groupBy("tenant_id", "bucket", "service").agg(F.count(F.lit(1)).alias("entries"), (fits[0] & fits[1] & fits[2]).alias("within_error"))
