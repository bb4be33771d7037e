"""Queries L1–L9: alert rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.functions.columns import breached
from loglake.operators import alerts as L
from loglake.plans.fixtures import LOGS, RULES, T_FROM, T_TO, logs, rules, table
from loglake.plans.registry import query, rounded

_NOW = "2024-01-30 12:00:00"

_MEASURE = "CASE measure WHEN 'count' THEN CAST(count(l.id) AS DOUBLE) WHEN 'sum' THEN sum(l.duration_ms) WHEN 'avg' THEN avg(l.duration_ms) ELSE max(l.duration_ms) END"
_HIT = """CASE trim(threshold_operator) WHEN '>' THEN actual_value > threshold_value WHEN '<' THEN actual_value < threshold_value
  WHEN '>=' THEN actual_value >= threshold_value WHEN '<=' THEN actual_value <= threshold_value WHEN '==' THEN actual_value = threshold_value
  WHEN '=' THEN actual_value = threshold_value ELSE false END"""

_EVALUATED = LOGS + ", " + RULES + f""", vals AS (SELECT r.rule_id, r.tenant_id, r.name, r.threshold_operator, r.threshold_value, r.notification_channel, {_MEASURE} AS actual_value
  FROM rules r LEFT JOIN logs l ON l.tenant_id = r.tenant_id AND (r.log_type IS NULL OR r.log_type = l.log_type) AND (r.level IS NULL OR r.level = l.level)
    AND l.timestamp >= TIMESTAMP '{_NOW}' - to_minutes(r.window_minutes) AND l.timestamp <= TIMESTAMP '{_NOW}'
  WHERE r.is_enabled GROUP BY r.rule_id, r.tenant_id, r.name, r.threshold_operator, r.threshold_value, r.notification_channel, measure),
evaluated AS (SELECT *, CASE WHEN actual_value IS NULL THEN 'no_result' WHEN trim(threshold_operator) = '!=' THEN 'bad_operator' ELSE 'evaluated' END AS status,
  coalesce({_HIT}, false) AS is_breached FROM vals)
"""


@query("l1_evaluate_rules", _EVALUATED + "SELECT rule_id, tenant_id, round(actual_value + 1e-9, 6) AS actual_value, status, is_breached FROM evaluated")
def _(spark, sf):
    rows = L.evaluate_rules(logs(spark, sf), rules(spark, sf), _NOW)
    return rows.select("rule_id", "tenant_id", rounded("actual_value").alias("actual_value"), "status", "is_breached")


_WEEK = _EVALUATED.replace("r.window_minutes", "10080")


@query("l1_week_rules", _WEEK + "SELECT rule_id, tenant_id, round(actual_value + 1e-9, 6) AS actual_value, status, is_breached FROM evaluated")
def _(spark, sf):
    weekly = rules(spark, sf).withColumn("window_minutes", F.lit(7 * 1440))
    rows = L.evaluate_rules(logs(spark, sf), weekly, _NOW)
    return rows.select("rule_id", "tenant_id", rounded("actual_value").alias("actual_value"), "status", "is_breached")


_SAME_ID = _EVALUATED.replace("CAST(c_custkey AS STRING) AS rule_id", "CAST(c_custkey // 4 AS STRING) AS rule_id")


@query("l1_equal_rule_ids", _SAME_ID + "SELECT rule_id, tenant_id, name, round(actual_value + 1e-9, 6) AS actual_value, status, is_breached FROM evaluated")
def _(spark, sf):
    """One rule id in up to four tenants."""
    shared = rules(spark, sf).withColumn("rule_id", F.floor(F.col("rule_id").cast("long") / 4).cast("string"))
    rows = L.evaluate_rules(logs(spark, sf), shared, _NOW)
    return rows.select("rule_id", "tenant_id", "name", rounded("actual_value").alias("actual_value"), "status", "is_breached")


# A short list of rules given as SQL.
_SQL_RULES = [
    ("r1", "tenant-0", "many errors", "SELECT count(*) FROM logs WHERE level = 'Error'", ">", 5.0),
    ("r2", "tenant-1", "slowest", "SELECT max(duration_ms), 1 FROM logs", ">=", 100.0),
    ("r3", "tenant-2", "text number", "SELECT CAST(count(*) AS STRING) AS n FROM logs", "<", 10.0),
    ("r4", "tenant-3", "no rows", "SELECT duration_ms FROM logs WHERE level = 'Nothing'", ">", 0.0),
    ("r5", "tenant-0", "not a number", "SELECT min(message) FROM logs", ">", 0.0),
    ("r6", "tenant-0", "broken", "SELECT nothing FROM logs", ">", 0.0),
]


@query(
    "l1_sql_rules",
    LOGS + """SELECT 'r1' AS rule_id, CAST(count(*) AS DOUBLE) AS actual_value, 'evaluated' AS status, count(*) > 5 AS is_breached FROM logs WHERE tenant_id = 'tenant-0' AND level = 'Error'
    UNION ALL SELECT 'r2', max(duration_ms), 'evaluated', max(duration_ms) >= 100 FROM logs WHERE tenant_id = 'tenant-1'
    UNION ALL SELECT 'r3', CAST(count(*) AS DOUBLE), 'evaluated', count(*) < 10 FROM logs WHERE tenant_id = 'tenant-2'
    UNION ALL SELECT 'r4', NULL, 'no_result', false UNION ALL SELECT 'r5', NULL, 'no_result', false
    UNION ALL SELECT 'r6', NULL, 'error: AnalysisException', false""",
)
def _(spark, sf):
    names = ["rule_id", "tenant_id", "name", "sql", "threshold_operator", "threshold_value"]
    given = [dict(zip(names, r)) for r in _SQL_RULES]
    return L.evaluate_sql_rules(spark, logs(spark, sf), given).select("rule_id", "actual_value", "status", "is_breached")


_OPS = "CASE event_id % 8 WHEN 0 THEN '>' WHEN 1 THEN '<' WHEN 2 THEN '>=' WHEN 3 THEN '<=' WHEN 4 THEN '==' WHEN 5 THEN ' = ' WHEN 6 THEN '!=' END"


@query(
    "l2_breached",
    f"""WITH v AS (SELECT event_id, value AS actual_value, CAST(floor(value) AS DOUBLE) AS threshold_value, {_OPS} AS threshold_operator FROM events)
    SELECT event_id, CAST(CASE trim(threshold_operator) WHEN '>' THEN actual_value > threshold_value WHEN '<' THEN actual_value < threshold_value
      WHEN '>=' THEN actual_value >= threshold_value WHEN '<=' THEN actual_value <= threshold_value WHEN '==' THEN actual_value = threshold_value
      WHEN '=' THEN actual_value = threshold_value END AS VARCHAR) AS hit FROM v""",
)
def _(spark, sf):
    rows = table(spark, sf, "events")
    threshold = F.floor("value").cast("double")
    return rows.select("event_id", breached(F.col("value"), F.expr(_OPS), threshold).cast("string").alias("hit"))


@query(
    "l3_fired_events",
    _EVALUATED + f"""SELECT rule_id, tenant_id, name AS rule_name, round(actual_value + 1e-9, 6) AS actual_value, threshold_value, threshold_operator, notification_channel,
      TIMESTAMP '{_NOW}' AS fired_at FROM evaluated WHERE is_breached""",
)
def _(spark, sf):
    events = L.fired_events(L.evaluate_rules(logs(spark, sf), rules(spark, sf), _NOW), _NOW)
    return events.drop("event_id", "destinations").withColumn("actual_value", rounded("actual_value"))


_CONDITION = """CASE event_id % 12 WHEN 0 THEN concat('count > ', CAST(user_id AS STRING)) WHEN 1 THEN concat('avg >= -', CAST(user_id AS STRING), '.5 ms')
  WHEN 2 THEN concat('x == ', CAST(user_id AS STRING)) WHEN 3 THEN concat('<=', CAST(user_id AS STRING), '.25') WHEN 4 THEN concat('p99 < +', CAST(user_id AS STRING))
  WHEN 5 THEN concat('value = ', CAST(user_id AS STRING)) WHEN 6 THEN 'GreaterThan' WHEN 7 THEN ' Equals ' WHEN 8 THEN 'LessThan' WHEN 9 THEN ''
  WHEN 10 THEN concat('about ', CAST(user_id AS STRING)) END"""
_PARSED_OP = """CASE WHEN trim(coalesce(c, '')) = '' THEN NULL WHEN contains(c, '>=') THEN '>=' WHEN contains(c, '<=') THEN '<=' WHEN contains(c, '==') THEN '=='
  WHEN contains(c, '>') THEN '>' WHEN contains(c, '<') THEN '<' WHEN contains(c, '=') THEN '=' WHEN trim(c) = 'GreaterThan' THEN '>'
  WHEN trim(c) = 'LessThan' THEN '<' WHEN trim(c) IN ('Equal', 'Equals') THEN '==' ELSE trim(c) END"""
_PARSED_NUMBER = "TRY_CAST(nullif(regexp_extract(c, '[-+]?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE)"


@query(
    "l4_parse_condition",
    f"WITH v AS (SELECT event_id, {_CONDITION} AS c FROM events) SELECT event_id, {_PARSED_OP} AS parsed_operator, {_PARSED_NUMBER} AS parsed_threshold FROM v",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(_CONDITION).alias("condition"))
    return L.parse_condition(rows).select("event_id", "parsed_operator", "parsed_threshold")


_REQUEST_FIELDS = [
    "event_id",
    "CASE event_id % 20 WHEN 1 THEN ' ' WHEN 2 THEN repeat('n', 257) ELSE concat('rule ', event_type) END AS name",
    "CASE event_id % 20 WHEN 3 THEN NULL WHEN 4 THEN repeat('s', 20001) ELSE 'SELECT 1' END AS sql",
    _CONDITION + " AS condition",
    "CASE event_id % 20 WHEN 5 THEN '>' WHEN 6 THEN 'Equal' WHEN 7 THEN '!=' END AS comparison_operator",
    "CASE event_id % 20 WHEN 8 THEN value WHEN 9 THEN CAST('Infinity' AS DOUBLE) END AS threshold",
    "CASE event_id % 20 WHEN 10 THEN 0 WHEN 11 THEN 1441 WHEN 12 THEN 1440 END AS evaluation_interval_minutes",
]
_REQUEST = ", ".join(_REQUEST_FIELDS)


@query(
    "l5_validate_rules",
    f"""WITH q AS (SELECT {_REQUEST}, event_id % 20 AS v FROM events), p AS (SELECT *, CASE WHEN comparison_operator = 'Equal' THEN '==' ELSE comparison_operator END AS given, condition AS c FROM q),
    r AS (SELECT *, coalesce(given, {_PARSED_OP}) AS op, coalesce(threshold, {_PARSED_NUMBER}) AS th FROM p)
    SELECT event_id, array_to_string(list_filter([
      CASE WHEN trim(name) = '' THEN 'name is required' END, CASE WHEN length(name) > 256 THEN 'name is too long' END,
      CASE WHEN sql IS NULL THEN 'sql is required' END, CASE WHEN length(sql) > 20000 THEN 'sql is too long' END,
      CASE WHEN op IS NULL THEN 'operator is required' END, CASE WHEN op NOT IN ('>', '<', '>=', '<=', '==', '=') THEN 'operator is not supported' END,
      CASE WHEN th IS NULL THEN 'threshold is required' END, CASE WHEN isinf(th) THEN 'threshold is not finite' END,
      CASE WHEN evaluation_interval_minutes NOT BETWEEN 1 AND 1440 THEN 'interval is out of range' END,
      CASE WHEN v = 13 THEN 'too many channels' END, CASE WHEN v = 14 THEN 'channel is blank' END, CASE WHEN v = 15 THEN 'too many destinations' END],
      lambda x: x IS NOT NULL), '; ') AS errors FROM r""",
)
def _(spark, sf):
    v = F.col("event_id") % 20
    channels = F.when(v == 13, F.array_repeat(F.lit("slack"), 11)).when(v == 14, F.array(F.lit("slack"), F.lit(" "))).when(v == 16, F.array(F.lit("webhook")))
    destination = F.struct(F.lit("slack").alias("type"), F.lit("https://x.example.com/").alias("webhook_url"))
    rows = table(spark, sf, "events").selectExpr(*_REQUEST_FIELDS).withColumns(
        {"notification_channels": channels, "destinations": F.when(v == 15, F.array_repeat(destination, 11))}
    )
    return L.validate_rules(rows).select("event_id", F.array_join("errors", "; ").alias("errors"))


_TYPE = "CASE page_id % 6 WHEN 0 THEN 'slack' WHEN 1 THEN 'Webhook' WHEN 2 THEN 'email' WHEN 3 THEN '' WHEN 4 THEN 'webhook' ELSE repeat('t', 33) END"
_URL = """CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'https://') WHEN 2 THEN concat('http://localhost:', CAST(8000 + page_id % 100 AS STRING), '/hook?x=1')
  WHEN 3 THEN concat(replace(url, 'http://', 'https://'), '#frag') WHEN 4 THEN NULL WHEN 5 THEN concat('https://example.com/', repeat('p', 2048)) ELSE 'HTTP://127.0.0.1/hook' END"""
_GOOD_URL = """coalesce(NOT contains(url, '#') AND (regexp_full_match(lower(url), 'https://[^/?#\\s]+[^#\\s]*')
  OR regexp_full_match(lower(url), 'http://(localhost|127\\.[0-9]+\\.[0-9]+\\.[0-9]+)(:[0-9]+)?([/?][^#\\s]*)?')), false)"""


@query(
    "l6_validate_destinations",
    f"""WITH d AS (SELECT page_id, {_TYPE} AS type, {_URL} AS url FROM pages)
    SELECT page_id, array_to_string(list_filter([
      CASE WHEN trim(type) = '' THEN 'type is required' END, CASE WHEN length(type) > 32 THEN 'type is too long' END,
      CASE WHEN lower(type) NOT IN ('slack', 'webhook') THEN 'type is not supported' END, CASE WHEN url IS NULL THEN 'url is required' END,
      CASE WHEN length(url) > 2048 THEN 'url is too long' END, CASE WHEN NOT {_GOOD_URL} THEN 'url is not allowed' END], lambda x: x IS NOT NULL), '; ') AS errors FROM d""",
)
def _(spark, sf):
    rows = table(spark, sf, "pages").select(
        "page_id", F.expr(_TYPE).alias("type"), F.expr(_URL).alias("webhook_url"), F.lit(None).cast("string").alias("integration_key")
    )
    return L.validate_destinations(rows).select("page_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "l7_due_rules",
    "WITH " + RULES + f""", ran AS (SELECT CAST(user_id AS VARCHAR) AS rule_id, concat('tenant-', CAST(user_id % 3 AS VARCHAR)) AS tenant_id, max(ts) AS evaluated_at FROM events GROUP BY 1, 2)
    SELECT r.rule_id, evaluated_at FROM rules r LEFT JOIN ran USING (tenant_id, rule_id) WHERE is_enabled
      AND (evaluated_at IS NULL OR evaluated_at + to_seconds(evaluation_interval_seconds * 1000) <= TIMESTAMP '{_NOW}')""",
)
def _(spark, sf):
    # A run of another tenant's rule of the same id counts for nothing.
    tenant = F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id")
    ran = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("rule_id"), tenant).agg(F.max("ts").alias("evaluated_at"))
    slow = rules(spark, sf).withColumn("evaluation_interval_seconds", F.col("evaluation_interval_seconds") * 1000)
    return L.due_rules(slow, ran, _NOW).select("rule_id", "evaluated_at")


_NUMBER = "CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


@query(
    "l8_notification_rows",
    _EVALUATED + f""", fired AS (SELECT e.rule_id, e.tenant_id, concat(e.name, ' fired: ', {_NUMBER.format(c='round(actual_value + 1e-9, 3)')}, ' ', e.threshold_operator, ' ', {_NUMBER.format(c='e.threshold_value')}) AS text,
      CAST(e.rule_id AS BIGINT) % 4 AS d FROM evaluated e WHERE is_breached)
    SELECT rule_id, tenant_id, text, NULL AS destination_type, 'audit' AS action FROM fired WHERE d = 0
    UNION ALL SELECT rule_id, tenant_id, text, 'slack', 'send' FROM fired WHERE d IN (1, 2)
    UNION ALL SELECT rule_id, tenant_id, text, 'webhook', 'skip' FROM fired WHERE d = 2
    UNION ALL SELECT rule_id, tenant_id, text, 'email', 'unsupported' FROM fired WHERE d = 3""",
)
def _(spark, sf):
    evaluated = L.evaluate_rules(logs(spark, sf), rules(spark, sf), _NOW).withColumn("actual_value", rounded("actual_value", 3))
    rows = L.notification_rows(L.fired_events(evaluated, _NOW))
    return rows.select("rule_id", "tenant_id", "text", "destination_type", "action")


@query(
    "l9_backtest_rules",
    LOGS + ", " + RULES + f""", w AS (SELECT r.rule_id, r.tenant_id, r.name AS rule_name, threshold_operator, threshold_value, window_minutes, measure,
        floor(date_diff('second', TIMESTAMP '{T_FROM}', l.timestamp) / (60.0 * window_minutes)) AS k, l.id, l.duration_ms
      FROM rules r JOIN logs l ON l.tenant_id = r.tenant_id AND (r.log_type IS NULL OR r.log_type = l.log_type) AND (r.level IS NULL OR r.level = l.level) WHERE r.is_enabled),
    grid AS (SELECT rule_id, tenant_id, name AS rule_name, threshold_operator, threshold_value, window_minutes,
        unnest(range(0, CAST(ceil(date_diff('second', TIMESTAMP '{T_FROM}', TIMESTAMP '{T_TO}') / (60.0 * window_minutes)) AS BIGINT))) AS k FROM rules WHERE is_enabled AND measure = 'count'),
    silent AS (SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.rule_id = g.rule_id AND w.k = g.k)),
    vals AS (SELECT rule_id, tenant_id, rule_name, threshold_operator, threshold_value, TIMESTAMP '{T_FROM}' + to_minutes(CAST(k * window_minutes AS BIGINT)) AS window_start, 0.0 AS actual_value FROM silent
    UNION ALL SELECT rule_id, tenant_id, rule_name, threshold_operator, threshold_value, TIMESTAMP '{T_FROM}' + to_minutes(CAST(k * window_minutes AS BIGINT)) AS window_start,
      {_MEASURE.replace('l.', '')} AS actual_value FROM w GROUP BY rule_id, tenant_id, rule_name, threshold_operator, threshold_value, k, window_minutes, measure)
    SELECT rule_id, tenant_id, rule_name, window_start, round(actual_value + 1e-9, 6) AS actual_value, threshold_operator, threshold_value, true AS is_historical
    FROM vals WHERE {_HIT}""",
)
def _(spark, sf):
    fired = L.backtest_rules(logs(spark, sf), rules(spark, sf), T_FROM, T_TO)
    return fired.withColumn("actual_value", rounded("actual_value"))
