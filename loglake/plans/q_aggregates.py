"""Queries A1–A29: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.operators import aggregates as A
from loglake.operators.charts import gauge_value, stat_value
from loglake.operators.dedup import duplicate_rate, duplicates
from loglake.operators.filters import name_in
from loglake.plans.fixtures import AS_OF, DELIVERIES, LOGS, QLOG, T_FROM, T_TO, deliveries, logs, query_log
from loglake.plans.registry import query, rounded

EXACT = 1_000_000  # percentile accuracy at which the check tables are exact


@query(
    "a1_error_rate_per_minute",
    LOGS + f"""SELECT tenant_id, date_trunc('minute', timestamp) AS minute_bucket, source_id AS service, count(*) AS error_count
    FROM logs WHERE log_type = 'Error' AND level IN ('Error', 'Fatal') AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY
    GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return A.error_rate_per_minute(logs(spark, sf), AS_OF, "31 DAYS", ("tenant_id",))


@query(
    "a2_latency_percentiles",
    LOGS + f"""SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS bucket, source_id AS service,
      quantile_disc(metric_value, 0.5) AS p50_ms, quantile_disc(metric_value, 0.95) AS p95_ms, quantile_disc(metric_value, 0.99) AS p99_ms
    FROM logs WHERE log_type = 'Metric' AND category = 'http-latency' AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY
    GROUP BY 1, 2""",
)
def _(spark, sf):
    return A.latency_percentiles(logs(spark, sf), AS_OF, "31 DAYS")


@query(
    "a3_log_volume_by_type",
    LOGS + f"""SELECT date_trunc('minute', timestamp) AS minute_bucket, log_type AS logtype, count(*) AS entry_count
    FROM logs WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY GROUP BY 1, 2""",
)
def _(spark, sf):
    return A.log_volume_by_type(logs(spark, sf), AS_OF, "31 DAYS")


@query(
    "a4_http_status_per_hour",
    LOGS + f"""SELECT date_trunc('hour', timestamp) AS hour_bucket, tag_http_status AS status_code, count(*) AS request_count
    FROM logs WHERE log_type = 'Metric' AND category = 'http-request' AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY
    GROUP BY 1, 2""",
)
def _(spark, sf):
    return A.http_status_per_hour(logs(spark, sf), AS_OF, "31 DAYS")


_RANGE = f"timestamp >= TIMESTAMP '{T_FROM}' AND timestamp < TIMESTAMP '{T_TO}'"


@query(
    "a5_error_heatmap",
    LOGS + f"""SELECT hour_of_day, day_of_week, count(*) AS error_count FROM logs
    WHERE lower(level) = 'error' AND {_RANGE} GROUP BY 1, 2""",
)
def _(spark, sf):
    return A.error_heatmap(logs(spark, sf), T_FROM, T_TO)


@query(
    "a6_latency_p99_trend",
    LOGS + f"""SELECT date_trunc('hour', timestamp) AS timestamp, service, quantile_disc(duration_ms, 0.99) AS p99_ms FROM logs
    WHERE duration_ms IS NOT NULL AND {_RANGE} GROUP BY 1, 2""",
)
def _(spark, sf):
    return A.latency_p99_trend(logs(spark, sf), T_FROM, T_TO)


@query("a7_error_gauge", LOGS + f"SELECT count(*) AS error_count FROM logs WHERE lower(level) = 'error' AND {_RANGE}")
def _(spark, sf):
    return A.error_gauge(logs(spark, sf), T_FROM, T_TO)


@query(
    "a8_top_errors",
    LOGS + f"""SELECT message, count(*) AS error_count FROM logs WHERE lower(level) = 'error' AND {_RANGE}
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, sf):
    return A.top_errors(logs(spark, sf), T_FROM, T_TO)


@query(
    "a9_status_distribution",
    LOGS + f"""SELECT status_code, count(*) AS count FROM logs WHERE status_code IS NOT NULL AND {_RANGE}
    GROUP BY 1""",
)
def _(spark, sf):
    return A.status_distribution(logs(spark, sf), T_FROM, T_TO)


@query(
    "a10_service_error_scatter",
    LOGS + f"""SELECT service, count(*) AS error_count, round(avg(duration_ms) + 1e-9, 6) AS avg_latency_ms FROM logs
    WHERE lower(level) = 'error' AND duration_ms IS NOT NULL AND {_RANGE} GROUP BY 1""",
)
def _(spark, sf):
    rows = A.service_error_scatter(logs(spark, sf), T_FROM, T_TO)
    return rows.withColumn("avg_latency_ms", rounded("avg_latency_ms"))


@query(
    "a11_volume_stacked",
    LOGS + f"""SELECT date_trunc('hour', timestamp) AS timestamp, log_type, count(*) AS count FROM logs WHERE {_RANGE}
    GROUP BY 1, 2""",
)
def _(spark, sf):
    return A.volume_stacked(logs(spark, sf), T_FROM, T_TO)


@query(
    "a12_alert_timeline",
    LOGS + f"""SELECT date_trunc('hour', timestamp) AS timestamp, count(*) AS alert_count FROM logs WHERE category = 'alert' AND {_RANGE}
    GROUP BY 1""",
)
def _(spark, sf):
    return A.alert_timeline(logs(spark, sf), T_FROM, T_TO)


@query(
    "a13_terms_agg_tag",
    LOGS + f"""SELECT tag_k AS key, count(*) AS count FROM logs
    WHERE timestamp >= TIMESTAMP '{T_FROM}' AND timestamp <= TIMESTAMP '{T_TO}'
      AND regexp_matches(lower(message), '(^|[^\\p{{L}}\\p{{N}}_])error($|[^\\p{{L}}\\p{{N}}_])') AND tag_k IS NOT NULL
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
)
def _(spark, sf):
    return A.terms_agg(logs(spark, sf), "k", "message:error", 100, T_FROM, T_TO)


@query(
    "a13_terms_agg_column",
    LOGS + "SELECT log_type AS key, count(*) AS count FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
)
def _(spark, sf):
    return A.terms_agg(logs(spark, sf), "logType")


@query(
    "a13_terms_agg_documents",
    "SELECT lang AS key, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
)
def _(spark, sf):
    from loglake.plans.fixtures import table

    docs = table(spark, sf, "documents").select(F.col("lang").alias("category"))
    return A.terms_agg(docs, "category")


@query("a14_date_histogram", LOGS + "SELECT date_trunc('hour', timestamp) AS bucket, count(*) AS count FROM logs GROUP BY 1")
def _(spark, sf):
    return A.date_histogram(logs(spark, sf), "hour")


@query("a15_count_by_service", LOGS + "SELECT source_id, count(*) AS count FROM logs GROUP BY 1")
def _(spark, sf):
    return A.count_by(logs(spark, sf), "source_id")


@query("a15_count_by_tenant", LOGS + "SELECT tenant_id, count(*) AS count FROM logs GROUP BY 1")
def _(spark, sf):
    return A.count_by(logs(spark, sf), "tenant_id")


@query("a15_fatal_by_service", LOGS + "SELECT source_id, count(*) AS count FROM logs WHERE lower(level) = 'fatal' GROUP BY 1")
def _(spark, sf):
    return A.count_by(name_in(logs(spark, sf), "level", "Fatal"), "source_id")


@query(
    "a16_slowest_endpoints",
    LOGS + """SELECT endpoint, max(duration_ms) AS max_ms FROM logs WHERE log_type = 'Metric'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, sf):
    return A.slowest(name_in(logs(spark, sf), "log_type", "Metric"))


@query(
    "a17_average_latency",
    LOGS + """SELECT endpoint, round(avg(duration_ms) + 1e-9, 6) AS avg_ms, count(*) AS requests FROM logs
    WHERE log_type = 'Metric' GROUP BY 1""",
)
def _(spark, sf):
    return A.average_latency(name_in(logs(spark, sf), "log_type", "Metric")).withColumn("avg_ms", rounded("avg_ms"))


@query(
    "a18_daily_errors",
    LOGS + f"""SELECT date_trunc('day', timestamp) AS day, count(*) AS error_count FROM logs
    WHERE lower(level) = 'error' AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY GROUP BY 1 ORDER BY 1""",
)
def _(spark, sf):
    return A.daily_errors(logs(spark, sf), AS_OF, "31 DAYS")


@query(
    "a19_weekly_percentile",
    LOGS + f"""SELECT quantile_disc(duration_ms, 0.99) AS p_ms, count(*) AS entries FROM logs
    WHERE source_id = 'svc-3' AND timestamp >= date_trunc('week', TIMESTAMP '{AS_OF}')""",
)
def _(spark, sf):
    return A.weekly_percentile(logs(spark, sf), "svc-3", AS_OF, 0.99, EXACT)


@query(
    "a19_exact_percentile",
    LOGS + """SELECT tenant_id, round(quantile_cont(duration_ms, 0.99) + 1e-9, 6) AS percentile FROM logs GROUP BY 1""",
)
def _(spark, sf):
    rows = A.exact_percentile(logs(spark, sf), ["tenant_id"], "duration_ms", 0.99)
    return rows.withColumn("percentile", rounded("percentile"))


@query(
    "a20_duplicates",
    DELIVERIES + "SELECT tenant_id, id, count(*) AS copies FROM deliveries GROUP BY 1, 2 HAVING count(*) >= 2",
)
def _(spark, sf):
    return duplicates(deliveries(spark, sf))


@query(
    "a21_duplicate_rate",
    DELIVERIES + """, rated AS (SELECT tenant_id, count(*) AS ingested, count(*) - count(DISTINCT id) AS skipped FROM deliveries GROUP BY 1)
    SELECT tenant_id, ingested, skipped, round(100.0 * skipped / ingested + 1e-9, 6) AS duplicate_pct,
      CASE WHEN 100.0 * skipped / ingested >= 10 THEN 'critical' WHEN 100.0 * skipped / ingested >= 5 THEN 'high'
        WHEN 100.0 * skipped / ingested >= 1 THEN 'elevated' ELSE 'normal' END AS band FROM rated""",
)
def _(spark, sf):
    return duplicate_rate(deliveries(spark, sf)).withColumn("duplicate_pct", rounded(F.col("duplicate_pct").cast("double")))


@query(
    "a22_ingestion_rate",
    LOGS + """SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS bucket, count(*) AS entries,
      round(count(*) / 300.0 + 1e-9, 6) AS per_second FROM logs GROUP BY 1""",
)
def _(spark, sf):
    return A.ingestion_rate(logs(spark, sf)).withColumn("per_second", rounded("per_second"))


@query(
    "a23_error_ratio",
    LOGS + """SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS bucket, count(*) AS entries,
      count(*) FILTER (lower(level) IN ('error', 'fatal')) AS errors,
      round(count(*) FILTER (lower(level) IN ('error', 'fatal')) / count(*) + 1e-9, 6) AS error_ratio FROM logs GROUP BY 1""",
)
def _(spark, sf):
    return A.error_ratio(logs(spark, sf)).withColumn("error_ratio", rounded("error_ratio"))


_BOUNDS_SQL = ", ".join(str(b) for b in A.LATENCY_BUCKETS)


@query(
    "a24_histogram_quantile",
    LOGS + f""", bounds AS (SELECT b, row_number() OVER (ORDER BY b) AS i FROM (SELECT unnest([{_BOUNDS_SQL}]) AS b)),
    cum AS (SELECT service, b, i, count(*) FILTER (duration_ms <= b) AS c, count(*) AS total FROM logs, bounds GROUP BY 1, 2, 3),
    steps AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY service ORDER BY i) AS below,
      lag(b, 1, 0) OVER (PARTITION BY service ORDER BY i) AS low FROM cum)
    SELECT service, any_value(total) AS total,
      round(coalesce(min_by(low + (b - low) * (0.99 * total - below) / nullif(c - below, 0), i) FILTER (c >= 0.99 * total), 10000) + 1e-9, 6) AS estimate
    FROM steps GROUP BY 1""",
)
def _(spark, sf):
    return A.histogram_quantile(logs(spark, sf), "duration_ms", 0.99, ["service"]).withColumn("estimate", rounded("estimate"))


@query(
    "a25_query_cost_by_tenant",
    QLOG + """SELECT tenant_id, date_trunc('day', submitted_at) AS day, round(sum(estimated_bytes / 1099511627776.0 * 5) + 1e-9, 6) AS cost_usd,
      count(*) AS queries, sum(estimated_bytes / 1099511627776.0 * 5) > 3.0 AS over_budget FROM qlog GROUP BY 1, 2""",
)
def _(spark, sf):
    from loglake.operators.governance import query_cost

    costed = query_log(spark, sf).withColumn("cost_usd", query_cost(F.col("estimated_bytes")))
    return A.query_cost_by_tenant(costed, alarm=3.0).withColumn("cost_usd", rounded("cost_usd"))


@query(
    "a26_stage_metrics",
    LOGS + """SELECT tenant_id, log_type, level, count(*) AS events, round(sum(duration_ms), 4) AS duration_total_ms,
      quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.99) AS p99_ms FROM logs GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    rows = A.stage_metrics(logs(spark, sf), ["tenant_id", "log_type", "level"], "duration_ms", EXACT)
    return rows.withColumn("duration_total_ms", F.round("duration_total_ms", 4))


@query("a27_stat_value", LOGS + "SELECT 'duration_ms' AS label, round(sum(duration_ms), 4) AS value FROM logs")
def _(spark, sf):
    return stat_value(logs(spark, sf), "duration_ms").withColumn("value", F.round("value", 4))


@query(
    "a27_gauge_value",
    LOGS + """SELECT 'error_count' AS label, CAST(count(*) AS DOUBLE) AS value,
      CASE WHEN count(*) <= 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * count(*) END AS max_value,
      CASE WHEN count(*) <= 0 THEN 1.0::DOUBLE ELSE CAST(count(*) AS DOUBLE) END AS remaining FROM logs WHERE lower(level) = 'error'""",
)
def _(spark, sf):
    return gauge_value(A.error_gauge(logs(spark, sf), None, None), "error_count")


@query(
    "a28_metric_rollup",
    LOGS + """SELECT date_trunc('hour', timestamp) AS bucket, category AS metric_name, metric_type, count(*) AS samples,
      CASE WHEN metric_type = 'Counter' THEN round(sum(metric_value), 4) END AS total,
      CASE WHEN metric_type = 'Gauge' THEN arg_max(metric_value, (timestamp, id)) END AS last_value,
      CASE WHEN metric_type = 'Gauge' THEN round(avg(metric_value) + 1e-9, 6) END AS mean_value,
      CASE WHEN metric_type IN ('Histogram', 'Summary') THEN quantile_disc(metric_value, 0.5) END AS p50,
      CASE WHEN metric_type IN ('Histogram', 'Summary') THEN quantile_disc(metric_value, 0.99) END AS p99
    FROM logs WHERE metric_value IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    rows = A.metric_rollup(logs(spark, sf))
    return rows.withColumns({"total": F.round("total", 4), "mean_value": rounded("mean_value")})


@query("a29_distinct_labels", LOGS + "SELECT DISTINCT tenant_id, source_id, log_type FROM logs")
def _(spark, sf):
    return logs(spark, sf).select("tenant_id", "source_id", "log_type").distinct()
