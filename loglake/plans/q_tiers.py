"""Queries G1–G10, U1, U2: tiers, query-log governance, cross-tier results."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.operators import governance as G
from loglake.operators import tiers as T
from loglake.operators.aggregates import count_by
from loglake.operators.governance import run_sql
from loglake.plans.fixtures import AS_OF, LOGS, QLOG, SETTINGS, logs, query_log, settings, table
from loglake.plans.registry import query, rounded

_NOW = "2024-01-28 00:00:00"
_DAYS = """CASE WHEN s.hot_retention_days > 0 THEN s.hot_retention_days ELSE 7 END AS hot_days,
  CASE WHEN s.warm_retention_days > 0 THEN s.warm_retention_days ELSE 90 END AS warm_days"""


@query(
    "g1_tier_of",
    LOGS + ", " + SETTINGS + f""", d AS (SELECT l.id, l.tenant_id, l.timestamp, {_DAYS} FROM logs l LEFT JOIN settings s USING (tenant_id))
    SELECT id, tenant_id, CASE WHEN timestamp >= TIMESTAMP '{AS_OF}' - to_days(hot_days) THEN 'Hot' WHEN timestamp >= TIMESTAMP '{AS_OF}' - to_days(warm_days) THEN 'Warm' ELSE 'Cold' END AS tier FROM d""",
)
def _(spark, sf):
    return T.with_tier(logs(spark, sf), settings(spark, sf), AS_OF).select("id", "tenant_id", "tier")


_ROUTED = QLOG + ", " + SETTINGS + f""", d AS (SELECT q.*, {_DAYS} FROM qlog q LEFT JOIN settings s USING (tenant_id)),
  c AS (SELECT *, TIMESTAMP '{_NOW}' AS now, TIMESTAMP '{_NOW}' - to_days(hot_days) AS hot, TIMESTAMP '{_NOW}' - to_days(warm_days) AS warm FROM d),
  routed AS (SELECT *, CASE WHEN has_full_text OR earliest IS NULL OR latest IS NULL OR (earliest >= hot AND latest <= now) THEN 'Hot'
    WHEN earliest >= warm AND latest < hot THEN 'Warm' WHEN earliest < warm AND latest < warm THEN 'Cold' ELSE 'CrossTier' END AS tier FROM c)
"""


def _routed(spark, sf):
    return T.route_queries(query_log(spark, sf), settings(spark, sf), _NOW)


@query(
    "g2_route_queries",
    _ROUTED + """SELECT query_id, tier, CASE WHEN has_full_text THEN 'full text search' WHEN earliest IS NULL THEN 'no time range' WHEN tier = 'Hot' THEN 'within hot window'
      WHEN tier = 'Warm' THEN 'within warm window' WHEN tier = 'Cold' THEN 'cold storage' WHEN earliest < warm THEN 'spans warm and cold' ELSE 'spans hot and warm' END AS reason,
      CASE WHEN tier = 'Cold' THEN 'cold storage: expect half a minute to two minutes' END AS warning FROM routed""",
)
def _(spark, sf):
    return _routed(spark, sf).select("query_id", "tier", "reason", "warning")


@query(
    "g3_split_ranges",
    _ROUTED + """, p AS (SELECT query_id, 'Hot' AS sub_tier, greatest(earliest, hot) AS range_from, latest AS range_to FROM routed WHERE tier = 'CrossTier'
      UNION ALL SELECT query_id, 'Warm', greatest(earliest, warm), least(latest, hot) FROM routed WHERE tier = 'CrossTier'
      UNION ALL SELECT query_id, 'Cold', earliest, least(latest, warm) FROM routed WHERE tier = 'CrossTier')
    SELECT * FROM p WHERE range_from < range_to""",
)
def _(spark, sf):
    return T.split_ranges(_routed(spark, sf), _NOW)


_LITERAL = "''([^'']{10,})''"


@query(
    "g4_sql_time_range",
    QLOG + f""", s AS (SELECT query_id, sql, CASE WHEN contains(lower(sql), 'where') THEN substr(sql, strpos(lower(sql), 'where')) ELSE sql END AS seg FROM qlog),
    f AS (SELECT query_id, sql, list_filter(list_transform(regexp_extract_all(seg, '{_LITERAL}', 1), lambda x: CAST(TRY_CAST(CASE WHEN length(x) > 19 THEN x ELSE concat(x, CASE WHEN length(x) > 10 THEN '+00' ELSE '' END) END AS TIMESTAMPTZ) AS TIMESTAMP)), lambda x: x IS NOT NULL) AS found FROM s)
    SELECT query_id, list_min(found) AS earliest, list_max(found) AS latest, list_min(found) IS NOT NULL AS has_time_filter, contains(upper(sql), 'LIMIT') AS has_limit,
      contains(upper(sql), 'SEARCH(') AS has_full_text FROM f""",
)
def _(spark, sf):
    rows = G.sql_time_range(query_log(spark, sf).select("query_id", "sql"))
    return rows.drop("sql")


_ERRORS_SQL = "[" + ", ".join(
    f"CASE WHEN contains(upper(sql), ' {w} ') OR starts_with(upper(sql), '{w}') THEN '{w} may not be used in a read-only query' END" for w in G.FORBIDDEN
) + "]"
_WARNINGS_SQL = """[CASE WHEN regexp_matches(upper(sql), '\\bCROSS\\s+JOIN\\b') THEN 'CROSS JOIN' END,
  CASE WHEN NOT (contains(upper(sql), 'YEAR') OR contains(upper(sql), 'MONTH') OR contains(upper(sql), 'DAY')) THEN 'no partition filter' END,
  CASE WHEN NOT contains(upper(sql), 'LIMIT') THEN 'no LIMIT' END]"""
_SAFE = QLOG + f""", safe AS (SELECT *, list_filter({_ERRORS_SQL}, lambda x: x IS NOT NULL) AS errors, list_filter({_WARNINGS_SQL}, lambda x: x IS NOT NULL) AS warnings FROM qlog)
"""


@query("g5_sql_safety", _SAFE + "SELECT query_id, array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings FROM safe")
def _(spark, sf):
    rows = G.sql_safety(query_log(spark, sf))
    return rows.select("query_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(
    "g5_sql_safety_strict",
    QLOG + "SELECT query_id, " + " + ".join(f"CAST(regexp_matches(upper(sql), '\\b{w}\\b') AS INTEGER)" for w in G.FORBIDDEN) + " AS problems FROM qlog",
)
def _(spark, sf):
    return G.sql_safety(query_log(spark, sf), strict=True).select("query_id", F.size("errors").alias("problems"))


@query(
    "g6_cost_guard",
    QLOG + """SELECT query_id, round(estimated_bytes / 1099511627776.0 * 5 + 1e-9, 6) AS cost_usd, CASE WHEN estimated_bytes > 107374182400 THEN 'Rejected'
      WHEN estimated_bytes / 1099511627776.0 * 5 > 0.05 THEN 'PendingCostConfirmation' ELSE 'Accepted' END AS decision FROM qlog""",
)
def _(spark, sf):
    return G.cost_guard(query_log(spark, sf)).select("query_id", rounded("cost_usd").alias("cost_usd"), "decision")


_USER_SQL = """SELECT service, count(*) AS entries, max(duration_ms) AS max_ms FROM logs
  WHERE year = {y} AND month = {m} AND lower(level) = {level} AND metric_value IS NULL GROUP BY service"""


@query("g8_run_sql", LOGS + _USER_SQL.format(y="'2024'", m="'01'", level="'error'").replace("metric_value", "tenant_id = 'tenant-3' AND metric_value"))
def _(spark, sf):
    sql = _USER_SQL.format(y=":year", m=":month", level=":level")
    return run_sql(spark, sql, logs(spark, sf), "tenant-3", {"year": "2024", "month": "01", "level": "error"}, cap=10_000)


@query(
    "g8_saved_query",
    LOGS + "SELECT service, count(*) AS entries FROM logs WHERE tenant_id = 'tenant-1' AND level IN ('Error', 'Fatal') GROUP BY service",
)
def _(spark, sf):
    """The text is looked up by tenant and id; another tenant's query of the same id is not seen."""
    saved = spark.sql(
        """SELECT concat('tenant-', CAST(n_nationkey AS STRING)) AS tenant_id, 'errors' AS query_id,
          CASE n_nationkey WHEN 1 THEN "SELECT service, count(*) AS entries FROM logs WHERE level IN ('Error', 'Fatal') GROUP BY service"
          ELSE 'SELECT 1 AS entries' END AS sql FROM {nation}""",
        nation=table(spark, sf, "nation"),
    )
    return G.run_saved(spark, saved, "tenant-1", "errors", logs(spark, sf))


@query(
    "g9_query_audit_report",
    _SAFE + """SELECT tenant_id, model, count(*) AS queries, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
      count(*) FILTER (len(errors) > 0) AS unsafe, count(*) FILTER (len(warnings) > 0) AS warned FROM safe GROUP BY 1, 2""",
)
def _(spark, sf):
    return G.query_audit_report(G.sql_safety(query_log(spark, sf)))


@query(
    "g10_policy_violations",
    QLOG + ", " + SETTINGS + """SELECT query_id, array_to_string(list_filter([
      CASE WHEN estimated_bytes > CASE WHEN max_query_scan_gb > 0 THEN max_query_scan_gb ELSE 10 END * 1073741824.0 THEN 'scan too large' END,
      CASE WHEN require_time_filter AND earliest IS NULL THEN 'time filter required' END,
      CASE WHEN require_limit AND NOT contains(sql, 'LIMIT') THEN 'limit required' END,
      CASE WHEN NOT coalesce(is_active, true) THEN 'tenant inactive' END], lambda x: x IS NOT NULL), '; ') AS violations FROM qlog LEFT JOIN settings USING (tenant_id)""",
)
def _(spark, sf):
    q = query_log(spark, sf).withColumns({"has_time_filter": F.col("earliest").isNotNull(), "has_limit": F.col("sql").contains("LIMIT")})
    return G.policy_violations(q, settings(spark, sf)).select("query_id", F.array_join("violations", "; ").alias("violations"))


@query(
    "u1_cross_tier",
    LOGS + """SELECT service, count(*) AS count FROM logs WHERE timestamp >= TIMESTAMP '2024-01-03 05:00:00' AND timestamp < TIMESTAMP '2024-01-30 07:00:00' GROUP BY 1""",
)
def _(spark, sf):
    rows = logs(spark, sf)
    return T.cross_tier(
        lambda df: count_by(df, "service"), rows, rows, rows, "2024-01-28 00:00:00", "2024-01-17 00:00:00", "2024-01-03 05:00:00", "2024-01-30 07:00:00"
    )


_STATUS = """CASE WHEN duration_ms > 140 THEN 'Failed' WHEN duration_ms > 120 THEN 'PendingCostConfirmation' WHEN duration_ms < 30 THEN 'Completed'
  WHEN duration_ms < 40 THEN 'Running' ELSE 'Pending' END"""


@query(
    "u2_merge_status",
    LOGS + f""", p AS (SELECT trace_id AS query_id, {_STATUS} AS s FROM logs) SELECT query_id, CASE WHEN bool_or(s = 'Failed') THEN 'Failed' WHEN bool_or(s = 'PendingCostConfirmation') THEN 'PendingCostConfirmation'
      WHEN bool_and(s = 'Completed') THEN 'Completed' WHEN bool_or(s = 'Running') THEN 'Running' ELSE 'Pending' END AS status, count(*) AS parts FROM p GROUP BY 1""",
)
def _(spark, sf):
    parts = logs(spark, sf).select(F.col("trace_id").alias("query_id"), F.expr(_STATUS).alias("status"))
    return T.merge_status(parts)
