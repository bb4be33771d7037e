"""Scalar functions of the fixed queries and the row code, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.functions import columns as C
from loglake.plans.fixtures import LOGS, logs, table
from loglake.plans.registry import query


@query(
    "fn_date_time",
    LOGS + """SELECT id, date_trunc('minute', timestamp) AS minute, date_trunc('hour', timestamp) AS hour_start, time_bucket(INTERVAL 5 MINUTE, timestamp) AS bucket5,
      CAST(extract('hour' FROM timestamp) AS INTEGER) AS hour_of_day, CAST(dayofweek(timestamp) AS INTEGER) AS day_of_week, timestamp_unix_ms,
      strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS iso, timestamp - INTERVAL 2 MINUTE AS two_minutes_before FROM logs""",
)
def _(spark, sf):
    rows = logs(spark, sf)
    return rows.select(
        "id", C.trunc_time(rows, "minute").alias("minute"), C.trunc_time(rows, "hour").alias("hour_start"),
        C.window_start("timestamp", "5 minutes").alias("bucket5"), "hour_of_day", "day_of_week", "timestamp_unix_ms",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (F.col("timestamp") - C.interval("2 MINUTES")).alias("two_minutes_before"),
    )


@query(
    "fn_string",
    """SELECT doc_id, length(text) AS n, lower(source) AS low, upper(lang) AS up, contains(text, 'the') AS has_the, starts_with(text, 'T') AS starts_t,
      regexp_extract(source, '[0-9]+') AS digits, replace(source, 'src', 'source-') AS renamed, concat_ws('/', lang, source) AS joined, trim(concat('  ', lang, ' ')) AS trimmed FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.length("text").cast("bigint").alias("n"), F.lower("source").alias("low"), F.upper("lang").alias("up"),
        F.contains("text", F.lit("the")).alias("has_the"), F.startswith("text", F.lit("T")).alias("starts_t"),
        F.regexp_extract("source", r"\d+", 0).alias("digits"), F.replace("source", F.lit("src"), F.lit("source-")).alias("renamed"),
        F.concat_ws("/", "lang", "source").alias("joined"), F.trim(F.concat(F.lit("  "), "lang", F.lit(" "))).alias("trimmed"),
    )


_FORMS = """CASE event_id % 14 WHEN 0 THEN 'true' WHEN 1 THEN ' FALSE' WHEN 2 THEN CAST(user_id AS STRING) WHEN 3 THEN '9223372036854775808' WHEN 4 THEN CAST(value AS STRING)
  WHEN 5 THEN '1,234.5' WHEN 6 THEN '-1e3' WHEN 7 THEN '1d' WHEN 8 THEN '2024-01-05' WHEN 9 THEN '2024-02-30' WHEN 10 THEN '2024-01-05T10:11:12Z' WHEN 11 THEN '' WHEN 12 THEN 'yes' END"""


@query(
    "fn_conversion",
    f"""WITH v AS (SELECT event_id, event_id % 14 AS f, {_FORMS} AS s, value, user_id FROM events)
    SELECT event_id, f IN (0, 1) AS is_bool, f = 2 AS is_int64, f IN (2, 3, 4, 5, 6) AS is_double, f IN (8, 10) AS is_timestamp,
      CASE f WHEN 2 THEN CAST(user_id AS DOUBLE) WHEN 3 THEN 9223372036854775808.0 WHEN 4 THEN value WHEN 5 THEN 1234.5 WHEN 6 THEN -1000.0 END AS number FROM v""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(_FORMS).alias("s"))
    s = C.stripped(F.col("s"))
    false = F.lit(False)
    return rows.select(
        "event_id", F.coalesce(C.parses_bool(s), false).alias("is_bool"), F.coalesce(C.parses_int64(s), false).alias("is_int64"),
        F.coalesce(C.parses_double(s), false).alias("is_double"), F.coalesce(C.parses_timestamp(s), false).alias("is_timestamp"), C.to_double(F.col("s")).alias("number"),
    )


@query(
    "fn_map_json",
    LOGS + """SELECT id, CASE WHEN tag_http_status IS NULL THEN 2 ELSE 3 END AS tags, tag_k AS k, tag_http_status IS NOT NULL AS has_status,
      tag_k AS k_again, true AS keys_short, CAST(tag_k AS INTEGER) < 50 AS all_below FROM logs""",
)
def _(spark, sf):
    rows = logs(spark, sf).withColumn("json", F.to_json("tags"))
    back = F.from_json("json", "map<string,string>")
    numbers = F.filter(F.map_values(back), lambda v: C.parses_int64(v) & (F.length(v) < 3))
    return rows.select(
        "id", F.size("tags").alias("tags"), F.try_element_at("tags", F.lit("k")).alias("k"), F.map_contains_key("tags", "http_status").alias("has_status"),
        F.get_json_object("json", "$.k").alias("k_again"), F.forall(F.map_keys("tags"), lambda k: F.length(k) <= 128).alias("keys_short"),
        F.forall(numbers, lambda v: v.cast("int") < 50).alias("all_below"),
    )


@query(
    "fn_null_handling",
    """SELECT page_id, coalesce(nullif(regexp_extract(url, 'page=([0-9]+)', 1), ''), '0') AS page, CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END AS kept,
      coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END, '') AS blanked, page_id % 3 = 0 AS blank FROM pages""",
)
def _(spark, sf):
    spaces = F.when(F.col("page_id") % 3 == 0, F.lit(" \t")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", F.coalesce(C.blank_to_null(F.regexp_extract("url", r"page=(\d+)", 1)), F.lit("0")).alias("page"),
        C.blank_to_null(spaces).alias("kept"), F.coalesce(C.blank_to_null(spaces), F.lit("")).alias("blanked"), C.is_blank(spaces).alias("blank"),
    )
