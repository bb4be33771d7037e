"""Queries T1, T3, T5–T10: streaming jobs run to completion over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T


from loglake.operators.joins import reconcile
from loglake.operators.search_index import Index, matching
from loglake.plans.fixtures import _DELIVERY_FIELDS, _DTOS_SPARK, _LOGS_SPARK, AS_OF, DELIVERIES, DTOS, LOGS, logs, rules, table
from loglake.plans.q_alerts import _EVALUATED, _NOW
from loglake.plans.registry import query, rounded
from loglake.session import new_path
from loglake.sources.files import STREAMED, read_archive
from loglake.streaming import jobs as J


def _events(spark, sf):
    """The events file as a stream; event time becomes an instant, which watermarks need."""
    row_type = table(spark, sf, "events").schema
    stream = J.file_stream(spark, sf, row_type, glob="events.parquet")
    return stream


def _log_stream(spark, sf):
    rows = spark.sql(_LOGS_SPARK, events=_events(spark, sf))
    return rows.withColumn("timestamp", F.col("timestamp").cast(T.TimestampType()))


@query(
    "t1_ingest_stream",
    DTOS + """SELECT DISTINCT tenant_id, CONCAT('c-', CAST(event_id % 4000 AS VARCHAR)) AS id FROM validated WHERE len(errors) = 0""",
)
def _(spark, sf):
    root = new_path(spark, "stream-archive")
    incoming = spark.sql(_DTOS_SPARK, events=_events(spark, sf)).withColumn(
        "id", F.concat(F.lit("c-"), (F.col("event_id") % 4000).cast("string"))
    )
    J.ingest_stream(incoming, F.col("tenant_id"), AS_OF, AS_OF, root, new_path(spark, "ckpt")).awaitTermination()
    return read_archive(spark, root).select("tenant_id", "id")


@query(
    "t1_search_branch",
    DTOS + """, i AS (SELECT tenant_id, concat('c-', CAST(event_id % 4000 AS VARCHAR)) AS id, message FROM validated WHERE len(errors) = 0),
    n AS (SELECT tenant_id, count(DISTINCT id) AS entries FROM i GROUP BY 1)
    SELECT tenant_id, entries AS archived, entries AS indexed, entries AS searchable, true AS in_tolerance FROM n""",
)
def _(spark, sf):
    """Both branches over the same input: the archive, the hot store and the search index hold the same entries."""
    archive, hot, index = (new_path(spark, n) for n in ("branch-archive", "branch-hot", "branch-index"))
    incoming = spark.sql(_DTOS_SPARK, events=_events(spark, sf)).withColumn(
        "id", F.concat(F.lit("c-"), (F.col("event_id") % 4000).cast("string"))
    )
    J.ingest_stream(incoming, F.col("tenant_id"), AS_OF, AS_OF, archive, new_path(spark, "ckpt")).awaitTermination()
    branch = J.search_branch(incoming, F.col("tenant_id"), AS_OF, AS_OF, hot, new_path(spark, "seen"), new_path(spark, "ckpt"), index)
    branch.awaitTermination()
    agree = reconcile(read_archive(spark, archive), spark.read.parquet(hot), ["tenant_id"])
    found = matching(Index(spark, index, "tenant_id string, id string"), "view OR click OR purchase OR signup OR error OR NOT k")
    searchable = found.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("searchable"))
    return agree.join(searchable, "tenant_id", "left").select("tenant_id", "archived", "indexed", "searchable", "in_tolerance")


@query(
    "t1_quarantine_stream",
    DTOS + "SELECT tenant_id, array_to_string(errors, '; ') AS reason, count(*) AS entries FROM validated WHERE len(errors) > 0 GROUP BY 1, 2",
)
def _(spark, sf):
    root = new_path(spark, "stream-quarantine")
    incoming = spark.sql(_DTOS_SPARK, events=_events(spark, sf))
    J.quarantine_stream(incoming, F.col("message"), AS_OF, root, new_path(spark, "ckpt")).awaitTermination()
    reason = F.array_join("reason", "; ").alias("reason")
    return spark.read.parquet(root).groupBy("tenant_id", reason).agg(F.count(F.lit(1)).alias("entries"))


@query("t2_flush_stream", DTOS + "SELECT tenant_id, count(*) AS entries, true AS small_files FROM validated WHERE len(errors) = 0 GROUP BY 1")
def _(spark, sf):
    """Files of a thousand rows at most; the event time stays, so validation sees the time of the data."""
    root = new_path(spark, "stream-flush")
    incoming = spark.sql(_DTOS_SPARK, events=_events(spark, sf)).withColumn("id", F.concat(F.lit("c-"), F.col("event_id").cast("string")))
    J.ingest_stream(
        incoming, F.col("tenant_id"), AS_OF, None, root, new_path(spark, "ckpt"), max_rows_per_file=J.FLUSH_ROWS
    ).awaitTermination()
    files = spark.read.parquet(f"{root}/{STREAMED}").groupBy("tenant_id", F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy("tenant_id").agg(F.sum("n").alias("entries"), (F.max("n") <= J.FLUSH_ROWS).alias("small_files"))


@query("t3_dedup_stream", DELIVERIES + "SELECT DISTINCT tenant_id, id FROM deliveries")
def _(spark, sf):
    root = new_path(spark, "stream-dedup")
    rows = spark.sql(f"SELECT {_DELIVERY_FIELDS} FROM {{events}}", events=_events(spark, sf))
    rows = rows.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    once = J.dedup_stream(rows, "40 days")
    J.for_each_batch(once, lambda b, i: J.write_batch(b, root, i), new_path(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(root).select("tenant_id", "id")


@query(
    "t5_view_stream",
    LOGS + f"""SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS bucket, source_id AS service, count(*) AS error_count FROM logs
    WHERE log_type = 'Error' AND level IN ('Error', 'Fatal') GROUP BY 1, 2
    HAVING bucket + INTERVAL 5 MINUTE <= (SELECT max(timestamp) FROM logs WHERE log_type = 'Error' AND level IN ('Error', 'Fatal')) - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    def view(rows):
        errors = rows.filter("log_type = 'Error' AND level IN ('Error', 'Fatal')")
        return errors.groupBy(F.window("timestamp", "5 minutes").alias("w"), F.col("source_id").alias("service")).agg(
            F.count(F.lit(1)).alias("error_count")
        ).select(F.col("w.start").alias("bucket"), "service", "error_count")

    root = new_path(spark, "stream-view")
    J.view_stream(_log_stream(spark, sf), view, root, new_path(spark, "ckpt")).awaitTermination()
    # Buckets that the watermark has not passed are not written yet.
    return spark.read.parquet(root)


_FIRED = _EVALUATED + "SELECT rule_id, tenant_id, round(actual_value + 1e-9, 6) AS actual_value FROM evaluated WHERE is_breached"


@query("t6_alert_stream", _FIRED)
def _(spark, sf):
    """Rules are evaluated from the cells that the stream keeps."""
    root = new_path(spark, "stream-alerts")
    rows = _log_stream(spark, sf)
    J.alert_stream(rows, rules(spark, sf), _NOW, root, new_path(spark, "ckpt"), cells=new_path(spark, "cells")).awaitTermination()
    return spark.read.parquet(root).select("rule_id", "tenant_id", rounded("actual_value").alias("actual_value"))


@query("t6_alert_store", _FIRED)
def _(spark, sf):
    """Rules look at the logs themselves."""
    root = new_path(spark, "stream-alerts")
    J.alert_stream(_log_stream(spark, sf), rules(spark, sf), _NOW, root, new_path(spark, "ckpt"), lambda: logs(spark, sf)).awaitTermination()
    return spark.read.parquet(root).select("rule_id", "tenant_id", rounded("actual_value").alias("actual_value"))


@query(
    "t7_late_data",
    LOGS + """SELECT id, CASE WHEN timestamp <= TIMESTAMP '2024-01-05 00:00:00' THEN 'late' ELSE 'future' END AS lateness FROM logs
    WHERE timestamp <= TIMESTAMP '2024-01-05 00:00:00' OR timestamp > TIMESTAMP '2024-01-25 00:05:00'""",
)
def _(spark, sf):
    _, side = J.late_split(logs(spark, sf), "2024-01-25 00:00:00", past="20 DAYS")
    return side.select("id", "lateness")


@query("t8_pull_stream", LOGS + "SELECT 'job-tenant' AS tenant_id, count(*) AS entries, max(timestamp) AS last_event FROM logs")
def _(spark, sf):
    root = new_path(spark, "stream-pull")
    J.pull_stream(_log_stream(spark, sf), "job-tenant", root, new_path(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(root).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("entries"), F.max("timestamp").alias("last_event"))


@query("t8_pull_counts", LOGS + "SELECT count(*) AS entries, max(timestamp) AS last_event, true AS small_files FROM logs")
def _(spark, sf):
    """Counts that the batches recorded, against files of 500 rows at most."""
    root, counts = new_path(spark, "stream-pull"), new_path(spark, "stream-counts")
    J.pull_stream(_log_stream(spark, sf), None, root, new_path(spark, "ckpt"), counts=counts).awaitTermination()
    sizes = spark.read.parquet(root).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"))
    small = sizes.agg((F.max("n") <= J.PULL_ROWS).alias("s")).scalar()
    recorded = spark.read.parquet(counts).agg(F.sum("entries").alias("entries"), F.max("last_event").alias("last_event"))
    return recorded.withColumn("small_files", small)


@query("t9_tenant_batches", LOGS + "SELECT tenant_id, count(*) AS entries FROM logs GROUP BY 1")
def _(spark, sf):
    root = new_path(spark, "stream-tenants")
    J.tenant_batches(_log_stream(spark, sf), root, new_path(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(root).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "t10_over_quota",
    LOGS + """, s AS (SELECT tenant_id, time_bucket(INTERVAL 900 SECOND, timestamp) AS segment, count(*) AS n FROM logs GROUP BY 1, 2),
    w AS (SELECT tenant_id, segment - to_seconds(900 * unnest([0, 1, 2, 3])) AS window_start, n FROM s)
    SELECT tenant_id, window_start, sum(n)::BIGINT AS requests FROM w GROUP BY 1, 2 HAVING sum(n) > 3""",
)
def _(spark, sf):
    return J.over_quota(logs(spark, sf), 3, window=3600, segments=4)
