"""Queries J1, J3–J8 and H1–H7: lookups, correlation, chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.operators import aggregates as A
from loglake.operators import charts as H
from loglake.operators import joins as J
from loglake.operators.alerts import rules_for
from loglake.operators.governance import run_sql
from loglake.plans.fixtures import LOGS, RULES, SETTINGS, logs, rules, settings, table
from loglake.plans.registry import query, rounded


@query(
    "j1_tenant_settings",
    LOGS + ", " + SETTINGS + """SELECT l.id, l.tenant_id, CASE WHEN s.hot_retention_days > 0 THEN s.hot_retention_days ELSE 7 END AS hot_days,
      CASE WHEN s.warm_retention_days > 0 THEN s.warm_retention_days ELSE 90 END AS warm_days
    FROM logs l LEFT JOIN settings s USING (tenant_id)""",
)
def _(spark, sf):
    return J.with_tenant_settings(logs(spark, sf).select("id", "tenant_id"), settings(spark, sf))


@query(
    "j3_rules_for",
    LOGS + ", " + RULES + """, batch AS (SELECT tenant_id, max(timestamp) AS newest, count(*) AS entries FROM logs GROUP BY 1)
    SELECT rule_id, tenant_id, newest, entries FROM batch JOIN rules USING (tenant_id) WHERE is_enabled""",
)
def _(spark, sf):
    batch = logs(spark, sf).groupBy("tenant_id").agg(F.max("timestamp").alias("newest"), F.count(F.lit(1)).alias("entries"))
    return rules_for(batch, rules(spark, sf)).select("rule_id", "tenant_id", "newest", "entries")


@query(
    "j4_trace_spans",
    LOGS + """SELECT tenant_id, trace_id, min(timestamp) AS started_at, max(timestamp) AS ended_at, count(*) AS entries,
      count(*) FILTER (lower(level) IN ('error', 'fatal')) AS errors, count(DISTINCT source_id) AS services,
      array_to_string(list_sort(list(DISTINCT source_id)), ',') AS service_list FROM logs GROUP BY 1, 2""",
)
def _(spark, sf):
    return J.trace_spans(logs(spark, sf))


@query(
    "j4_conversation_spans",
    """SELECT conv_id, count(*) AS entries, max(turn) AS last_turn, count(DISTINCT role) AS services,
      array_to_string(list_sort(list(DISTINCT role)), ',') AS service_list FROM conversations GROUP BY 1""",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.lit("all").alias("tenant_id"),
        F.col("conv_id").cast("string").alias("trace_id"),
        F.col("role").alias("source_id"),
        F.timestamp_seconds("turn").alias("timestamp"),
        F.lit("Information").alias("level"),
    )
    spans = J.trace_spans(turns)
    return spans.select(
        F.col("trace_id").cast("bigint").alias("conv_id"), "entries",
        F.unix_seconds("ended_at").alias("last_turn"), "services", "service_list",
    )


_VOLUME = LOGS + """, cells AS (SELECT date_trunc('hour', timestamp) AS label, log_type AS series, count(*) AS n FROM logs GROUP BY 1, 2)
"""


@query(
    "j5_densify",
    _VOLUME + """SELECT t.label, c.series, coalesce(n, 0) AS n FROM (SELECT DISTINCT label FROM cells) t CROSS JOIN (SELECT DISTINCT series FROM cells) c
    LEFT JOIN cells USING (label, series)""",
)
def _(spark, sf):
    rows = logs(spark, sf)
    cells = rows.groupBy(
        F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("label"), F.col("log_type").alias("series")
    ).agg(F.count(F.lit(1)).alias("n"))
    return J.densify(cells, "label", "series", "n")


@query(
    "j6_reports_with_sql",
    """SELECT CAST(o_orderkey AS VARCHAR) AS report_id, concat('tenant-', CAST(o_custkey % 4 AS VARCHAR)) AS tenant_id, CAST(o_custkey AS VARCHAR) AS query_id,
      concat('SELECT * FROM logs WHERE service = ''', c_name, '''') AS sql
    FROM orders JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 = o_custkey % 4""",
)
def _(spark, sf):
    def tenant(col):
        return F.concat(F.lit("tenant-"), (F.col(col) % 4).cast("string")).alias("tenant_id")

    reports = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("report_id"), tenant("o_custkey"), F.col("o_custkey").cast("string").alias("query_id")
    )
    saved = table(spark, sf, "customer").select(
        tenant("c_custkey"), F.col("c_custkey").cast("string").alias("query_id"),
        F.concat(F.lit("SELECT * FROM logs WHERE service = '"), "c_name", F.lit("'")).alias("sql"),
    )
    return J.reports_with_sql(reports, saved).select("report_id", "tenant_id", "query_id", "sql")


@query(
    "j7_reconcile",
    LOGS + """, a AS (SELECT tenant_id, day, count(*) AS archived FROM logs GROUP BY 1, 2),
    h AS (SELECT tenant_id, day, count(*) AS indexed FROM logs WHERE NOT (level = 'Fatal' OR tenant_id = 'tenant-3') GROUP BY 1, 2),
    j AS (SELECT tenant_id, day, coalesce(archived, 0) AS archived, coalesce(indexed, 0) AS indexed FROM a FULL JOIN h USING (tenant_id, day))
    SELECT *, archived - indexed AS difference, round(100.0 * abs(archived - indexed) / greatest(archived, indexed) + 1e-9, 6) AS difference_pct,
      100.0 * abs(archived - indexed) / greatest(archived, indexed) <= 1.0 AS in_tolerance FROM j""",
)
def _(spark, sf):
    rows = logs(spark, sf)
    hot = rows.filter("NOT (level = 'Fatal' OR tenant_id = 'tenant-3')")
    return J.reconcile(rows, hot, ["tenant_id", "day"]).withColumn("difference_pct", rounded("difference_pct"))


@query("j7_missing_ids", LOGS + "SELECT tenant_id, id FROM logs WHERE level = 'Fatal'")
def _(spark, sf):
    rows = logs(spark, sf)
    return J.missing_ids(rows, rows.filter("level <> 'Fatal'"))


_SQL_INNER = """SELECT c.c_mktsegment AS segment, n.n_name AS nation, count(*) AS entries, max(l.duration_ms) AS max_ms
  FROM logs l JOIN customer c ON CAST(l.id AS BIGINT) = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey < 20
  WHERE l.year = {year} GROUP BY 1, 2"""


@query(
    "j8_sql_inner_left",
    LOGS + _SQL_INNER.replace("{year}", "'2024' AND l.tenant_id = 'tenant-1'"),
)
def _(spark, sf):
    return run_sql(
        spark, _SQL_INNER.replace("{year}", ":year"), logs(spark, sf), "tenant-1", {"year": "2024"},
        customer=table(spark, sf, "customer"), nation=table(spark, sf, "nation"),
    )


_SQL_SEMI = """SELECT l.id, l.service FROM logs l
  WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = CAST(l.id AS BIGINT) AND o.o_orderstatus = 'F')
    AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = CAST(l.id AS BIGINT) AND c.c_acctbal < l.duration_ms)"""


@query("j8_sql_semi_anti", LOGS + _SQL_SEMI + " AND l.tenant_id = 'tenant-2'")
def _(spark, sf):
    return run_sql(spark, _SQL_SEMI, logs(spark, sf), "tenant-2", orders=table(spark, sf, "orders"), customer=table(spark, sf, "customer"))


_SQL_FULL = """SELECT coalesce(l.k, c.k, -1) AS k, coalesce(l.entries, 0) AS entries, coalesce(c.customers, 0) AS customers FROM
  (SELECT CAST(status_code AS BIGINT) % 7 AS k, count(*) AS entries FROM {logs} GROUP BY 1) l
  FULL JOIN (SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) AS customers FROM customer GROUP BY 1) c ON l.k = c.k"""


@query("j8_sql_full", LOGS + _SQL_FULL.replace("{logs}", "logs WHERE tenant_id = 'tenant-0'"))
def _(spark, sf):
    return run_sql(spark, _SQL_FULL.replace("{logs}", "logs"), logs(spark, sf), "tenant-0", customer=table(spark, sf, "customer"))


@query(
    "j8_tpch_revenue",
    """SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def _(spark, sf):
    sql = """SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""
    names = ["orders", "customer", "nation", "region"]
    return run_sql(spark, sql, logs(spark, sf), "tenant-0", **{n: table(spark, sf, n) for n in names})


# -- charts ------------------------------------------------------------------------

_NAMES = "timestamp count service hour_of_day day_of_week duration_ms request_bytes latency_ms level p99_ms error_count minute_bucket Occurrences updated".split()
_NAME_SQL = "CASE CAST(substr(md5(CAST(event_id AS STRING)), 1, 1) AS STRING) " + " ".join(
    f"WHEN '{h}' THEN '{n}'" for h, n in zip("0123456789abcd", _NAMES)
) + " ELSE 'count' END"
_COLUMN_FIELDS = f"""
  CAST(floor(event_id / 3) AS BIGINT) AS result_id,
  CASE WHEN CAST(floor(event_id / 3) AS BIGINT) % 4 = 0 THEN 1 ELSE 10 END AS row_count,
  CAST(event_id % 3 AS INT) AS position,
  {_NAME_SQL} AS name
"""
_COLUMN_FLAGS = """name NOT IN ('timestamp', 'service', 'level', 'minute_bucket', 'updated') AS is_numeric,
  name IN ('timestamp', 'minute_bucket') AND position < 2 AS is_timestamp, name IN ('service', 'level') AS is_categorical"""
_COLUMNS = f"WITH cols AS (SELECT *, {_COLUMN_FLAGS} FROM (SELECT {_COLUMN_FIELDS} FROM events) x)\n"


def _result_columns(spark, sf):
    return spark.sql(f"SELECT *, {_COLUMN_FLAGS} FROM (SELECT {_COLUMN_FIELDS} FROM {{events}}) x", events=table(spark, sf, "events"))


_SUGGEST = _COLUMNS + """, f AS (SELECT result_id, max(row_count) AS rc, count(*) FILTER (is_numeric) AS numbers,
    bool_or(is_timestamp OR contains(lower(name), 'time') OR contains(lower(name), 'date') OR contains(lower(name), 'bucket')) AS t,
    bool_or(lower(name) IN ('count', 'error_count', 'occurrences')) AS c, bool_or(is_categorical) AS k,
    bool_or(name = 'hour_of_day') AND bool_or(name = 'day_of_week') AS hd,
    (bool_or(name = 'duration_ms') AND bool_or(name = 'request_bytes')) OR (bool_or(name = 'p99_ms') AND bool_or(name = 'error_count')) AS co
  FROM cols GROUP BY 1),
  s AS (SELECT result_id, 'AreaChart' AS chart, 0.95 AS confidence FROM f WHERE t AND c
    UNION ALL SELECT result_id, 'LineChart', 0.90 FROM f WHERE t AND NOT c
    UNION ALL SELECT result_id, 'HeatMap', 0.88 FROM f WHERE hd AND c
    UNION ALL SELECT result_id, 'Gauge', 0.92 FROM f WHERE rc = 1 AND numbers = 1
    UNION ALL SELECT result_id, 'BarChart', 0.80 FROM f WHERE k AND c AND NOT t
    UNION ALL SELECT result_id, 'Scatter', 0.75 FROM f WHERE co
    UNION ALL SELECT result_id, 'StackedAreaChart', 0.70 FROM f WHERE t AND k)
"""


@query(
    "h1_suggest_charts",
    _SUGGEST + "SELECT result_id, chart, CAST(confidence AS DOUBLE) AS confidence, CAST(row_number() OVER (PARTITION BY result_id ORDER BY confidence DESC) AS INTEGER) AS rank FROM s",
)
def _(spark, sf):
    return H.suggest_charts(_result_columns(spark, sf)).select("result_id", "chart", "confidence", "rank")


@query(
    "h1_chart_choice",
    _SUGGEST + """, r AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY confidence DESC) AS rank FROM s)
    SELECT result_id, max(chart) FILTER (rank = 1) AS chart, string_agg(chart, ',' ORDER BY rank) FILTER (rank <= 3) AS alternatives FROM r GROUP BY 1""",
)
def _(spark, sf):
    return H.chart_choice(H.suggest_charts(_result_columns(spark, sf)))


_ERRORS_BY_HOUR = LOGS + """, v AS (SELECT date_trunc('hour', timestamp) AS hour_bucket, count(*) AS entries, count(*) FILTER (lower(level) = 'error') AS errors,
  max(CASE WHEN level = 'Fatal' THEN duration_ms END) AS worst_ms FROM logs GROUP BY 1)
"""


def _by_hour(spark, sf):
    rows = logs(spark, sf)
    return rows.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour_bucket")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.lower("level") == "error").alias("errors"),
        F.max(F.when(F.col("level") == "Fatal", F.col("duration_ms"))).alias("worst_ms"),
    )


@query(
    "h3_series_long",
    _ERRORS_BY_HOUR + """SELECT CAST(hour_bucket AS VARCHAR) AS label, 'entries' AS series, CAST(entries AS DOUBLE) AS value FROM v
    UNION ALL SELECT CAST(hour_bucket AS VARCHAR), 'errors', CAST(errors AS DOUBLE) FROM v
    UNION ALL SELECT CAST(hour_bucket AS VARCHAR), 'worst_ms', coalesce(worst_ms, 0.0) FROM v""",
)
def _(spark, sf):
    return H.series_long(_by_hour(spark, sf))


@query(
    "h4_matrix",
    LOGS + """SELECT CAST(hour_of_day AS VARCHAR) AS x, CAST(day_of_week AS VARCHAR) AS y, CAST(count(*) AS DOUBLE) AS v FROM logs WHERE lower(level) = 'error'
    GROUP BY hour_of_day, day_of_week""",
)
def _(spark, sf):
    cells = A.error_heatmap(logs(spark, sf), None, None)
    return H.matrix(cells.select(F.col("hour_of_day").cast("string").alias("hour_of_day"), F.col("day_of_week").cast("string").alias("day_of_week"), "error_count"))


@query(
    "h5_scatter_points",
    LOGS + "SELECT CAST(count(*) AS DOUBLE) AS x, max(duration_ms) AS y FROM logs GROUP BY endpoint",
)
def _(spark, sf):
    rows = logs(spark, sf).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.max("duration_ms").alias("m"))
    return H.scatter_points(rows)


@query(
    "h6_stacked_series",
    LOGS + """, r AS (SELECT date_trunc('hour', timestamp) AS label, coalesce(CASE WHEN category = 'event' THEN NULL ELSE category END, 'unknown') AS series, duration_ms, timestamp, id FROM logs),
    firsts AS (SELECT label, series, arg_min(duration_ms, (timestamp, id)) AS value FROM r GROUP BY 1, 2)
    SELECT t.label, c.series, coalesce(value, 0) AS value FROM (SELECT DISTINCT label FROM firsts) t CROSS JOIN (SELECT DISTINCT series FROM firsts) c
    LEFT JOIN firsts USING (label, series)""",
)
def _(spark, sf):
    rows = logs(spark, sf).withColumns(
        {"label": F.date_trunc("hour", "timestamp").cast("timestamp_ntz"), "category": F.when(F.col("category") != "event", F.col("category"))}
    )
    return H.stacked_series(rows, "label", "category", "duration_ms", ["timestamp", "id"])


@query("h7_stat_count", LOGS + "SELECT 'count' AS label, CAST(count(*) AS DOUBLE) AS value FROM logs")
def _(spark, sf):
    return H.stat_value(logs(spark, sf).select("message"))


@query(
    "h7_gauge",
    LOGS + "SELECT 'duration_ms' AS label, round(sum(duration_ms), 4) AS value, round(2 * sum(duration_ms), 4) AS max_value, round(sum(duration_ms), 4) AS remaining FROM logs",
)
def _(spark, sf):
    g = H.gauge_value(logs(spark, sf), "duration_ms")
    return g.withColumns({c: F.round(c, 4) for c in ("value", "max_value", "remaining")})
