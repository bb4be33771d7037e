"""Queries S1–S6, K1–K7, R1–R5, G7: reading, writing, retention and replay.

What they read back was written by Spark from the given tables to the session's shared folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loglake.operators import replay as R
from loglake.operators.governance import scan_estimate
from loglake.operators.ingest import validate_entries
from loglake.plans.fixtures import AS_OF, DELIVERIES, DTOS, LOGS, RULES, deliveries, dtos, entries, logs, rules, table
from loglake.plans.registry import once as _once
from loglake.plans.registry import query, rounded
from loglake.schema import LOG_ENTRY
from loglake.session import new_path
from loglake.sinks import storage_classes as C
from loglake.sinks import tables as K
from loglake.sinks.seen import accept_new
from loglake.sources import files as S

def _archive(spark, sf):
    return _once(spark, sf, "archive", lambda path: K.write_archive(entries(spark, sf), path))


# -- NDJSON ------------------------------------------------------------------------

_LINE_KIND = "event_id % 97"


def _ndjson_lines(spark, sf):
    """Entries as JSON lines, with broken and blank lines among them."""
    rows = entries(spark, sf).withColumn("event_id", F.col("id").cast("bigint"))
    json = F.to_json(F.struct(*[c for c in rows.columns if c != "event_id"]))
    line = (
        F.when(F.expr(_LINE_KIND) == 1, F.substring(json, 1, 40))
        .when(F.expr(_LINE_KIND) == 2, F.lit("   "))
        .when(F.expr(_LINE_KIND) == 3, F.lit("not json"))
        .otherwise(json)
    )
    return rows.select(line.alias("value"), F.date_format(F.timestamp_millis("timestamp_unix_ms"), "dd").alias("day"))


def _ndjson(spark, sf, codec="none"):
    def write(path):
        _ndjson_lines(spark, sf).select("value").write.option("compression", codec).text(path)

    return _once(spark, sf, f"ndjson-{codec}", write)


_READ = """SELECT id, 'job-tenant' AS tenant_id, source_id, log_type, level, timestamp_unix_ms, message, tag_k, metric_value, ingested_at FROM logs WHERE event_id % 97 NOT IN (1, 2, 3)"""


def _shown(rows):
    return rows.select(
        "id", "tenant_id", "source_id", "log_type", "level", "timestamp_unix_ms", "message",
        F.try_element_at("tags", F.lit("k")).alias("tag_k"), F.col("metric.value").alias("metric_value"), "ingested_at",
    )


_MILLIS = LOGS.replace("ts + INTERVAL 3 SECOND AS ingested_at", "date_trunc('millisecond', ts + INTERVAL 3 SECOND) AS ingested_at")


@query("s1_read_ndjson", _MILLIS + _READ)
def _(spark, sf):
    return _shown(S.read_ndjson(spark, _ndjson(spark, sf), "job-tenant"))


@query("s2_read_ndjson_gzip", _MILLIS + _READ)
def _(spark, sf):
    return _shown(S.read_ndjson(spark, _ndjson(spark, sf, "gzip"), "job-tenant"))


@query(
    "s1_unparsable_lines",
    "SELECT CASE event_id % 97 WHEN 3 THEN 'not json' ELSE 'cut' END AS kind, count(*) AS lines, 'invalid JSON' AS reason FROM events WHERE event_id % 97 IN (1, 3) GROUP BY 1",
)
def _(spark, sf):
    _, bad = S.parse_ndjson(spark.read.text(_ndjson(spark, sf)))
    kind = F.when(F.col("raw") == "not json", "not json").otherwise("cut")
    return bad.groupBy(kind.alias("kind"), F.array_join("reason", ",").alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


@query("s3_read_json_array", _MILLIS + _READ.replace(" WHERE event_id % 97 NOT IN (1, 2, 3)", ""))
def _(spark, sf):
    def write(path):
        rows = entries(spark, sf)
        page = F.floor(F.col("id").cast("bigint") / 100).alias("page")
        # One response page of at most a hundred entries per file. They lie in one folder, where tasks put them (version 2):
        # making a folder for each page and moving it when all tasks are done costs as much as the files.
        pages = rows.groupBy(page).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
        once_each = pages.select("value").write.option("maxRecordsPerFile", 1)
        once_each.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)

    path = _once(spark, sf, "json-pages", write)
    return _shown(S.read_json_array(spark, path, "job-tenant"))


def _daily_files(spark, sf):
    return _once(spark, sf, "ndjson-daily", lambda path: _ndjson_lines(spark, sf).hint("rebalance", "day").write.partitionBy("day").text(path))


@query("s4_pull_new_files", _MILLIS + _READ + " AND day > '11'")
def _(spark, sf):
    root = _daily_files(spark, sf)
    rows, _ = S.pull_new_files(spark, root, f"{S.key_of(root)}/day=11/~", "job-tenant", "*.txt")
    return _shown(rows)


@query("s4_next_key", "SELECT strftime(max(ts), '%d') AS day FROM events")
def _(spark, sf):
    _, state = S.pull_new_files(spark, _daily_files(spark, sf), None, "job-tenant", "*.txt")
    return state.select(F.regexp_extract("last_key", r"day=(\d+)/", 1).alias("day"))


# -- archive -----------------------------------------------------------------------

_FROM, _TO = dt.datetime(2024, 1, 9, 5, 30), dt.datetime(2024, 1, 23, 7, 15)
_IN_RANGE = "timestamp >= TIMESTAMP '2024-01-09 05:30:00' AND timestamp < TIMESTAMP '2024-01-23 07:15:00'"


@query("s6_read_archive", LOGS + f"SELECT id, tenant_id, service, level, message, metric_value, day, hour FROM logs WHERE tenant_id = 'tenant-2' AND {_IN_RANGE}")
def _(spark, sf):
    rows = S.read_archive(spark, _archive(spark, sf), "tenant-2", _FROM, _TO)
    return rows.select("id", "tenant_id", "service", "level", "message", "metric_value", "day", "hour")


@query("k1_write_archive", LOGS + "SELECT tenant_id, year, month, day, hour, count(*) AS entries FROM logs GROUP BY 1, 2, 3, 4, 5")
def _(spark, sf):
    rows = spark.read.schema(S.archive_schema()).parquet(_archive(spark, sf))
    return rows.groupBy("tenant_id", "year", "month", "day", "hour").agg(F.count(F.lit(1)).alias("entries"))


@query("k1_compact_archive", LOGS + "SELECT tenant_id, count(*) AS entries, count(DISTINCT id) AS ids FROM logs GROUP BY 1")
def _(spark, sf):
    target = new_path(spark, "compacted")
    K.compact_archive(spark, _archive(spark, sf), target)
    rows = spark.read.schema(S.archive_schema()).parquet(target)
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("id").alias("ids"))


def _second_write(first):
    """Later versions of some entries: new level, later ingest, some moved to another day."""
    n = F.col("id").cast("bigint")
    moved = F.when(n % 10 == 0, F.col("timestamp_unix_ms") - 86_400_000).otherwise(F.col("timestamp_unix_ms"))
    return first.filter(n % 5 == 0).withColumns(
        {"level": F.lit("Trace"), "ingested_at": F.col("ingested_at") + F.expr("INTERVAL 1 HOUR"), "timestamp_unix_ms": moved}
    )


@query(
    "k2_upsert_hot",
    LOGS + """SELECT tenant_id, id, CASE WHEN event_id % 5 = 0 THEN 'Trace' ELSE level END AS level,
      CAST(CAST(CASE WHEN event_id % 10 = 0 THEN timestamp - INTERVAL 1 DAY ELSE timestamp END AS DATE) AS VARCHAR) AS event_date FROM logs""",
)
def _(spark, sf):
    root = new_path(spark, "hot")
    first = entries(spark, sf)
    K.upsert_hot(first, root)
    K.upsert_hot(_second_write(first), root)
    return spark.read.parquet(root).select("tenant_id", "id", "level", F.col("event_date").cast("string").alias("event_date"))


@query(
    "k2_upsert_day",
    LOGS + """SELECT tenant_id, count(*) AS entries, count(*) FILTER (day = '15') AS changed,
      (SELECT count(DISTINCT tenant_id) FROM logs WHERE day = '15') AS partitions_read FROM logs GROUP BY 1""",
)
def _(spark, sf):
    """A batch of one day reads that day's partitions only."""
    root = new_path(spark, "hot")
    first = entries(spark, sf)
    K.upsert_hot(first, root)
    day = first.filter(F.day(F.timestamp_millis("timestamp_unix_ms")) == 15)
    read = K.upsert_hot(day.withColumn("level", F.lit("Day 15")).withColumn("ingested_at", F.col("ingested_at") + F.expr("INTERVAL 1 DAY")), root)
    rows = spark.read.parquet(root).groupBy("tenant_id")
    return rows.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("level") == "Day 15").alias("changed"), F.lit(read).alias("partitions_read")
    )


@query(
    "j2_seen_sets",
    DELIVERIES + """, b AS (SELECT *, CASE WHEN ingested_at < TIMESTAMP '2024-01-11' THEN 0 WHEN ingested_at < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS batch FROM deliveries),
    i AS (SELECT DISTINCT batch, tenant_id, id FROM b),
    storage AS (SELECT * FROM i x WHERE batch = 0 OR batch = 1 AND NOT EXISTS (SELECT 1 FROM i y WHERE y.batch = 0 AND y.tenant_id = x.tenant_id AND y.id = x.id)),
    late AS (SELECT * FROM i x WHERE batch = 2 AND NOT EXISTS (SELECT 1 FROM storage y WHERE y.batch = 1 AND y.tenant_id = x.tenant_id AND y.id = x.id)),
    every AS (SELECT 'storage' AS sink, * FROM storage UNION ALL SELECT 'storage', * FROM late UNION ALL SELECT 'search', * FROM i WHERE batch <> 1)
    SELECT sink, batch, tenant_id, id FROM every""",
)
def _(spark, sf):
    """Three batches, the last one past the first one's time-to-live but not the second one's; each sink has its own set.
    The search sink misses the second batch, and the storage sink is given it twice."""
    root, rows = new_path(spark, "seen"), deliveries(spark, sf)
    times = ["2024-01-10 00:00:00", "2024-01-10 12:00:00", "2024-01-11 06:00:00"]
    day = F.to_date("ingested_at")
    parts = [rows.filter(day < "2024-01-11"), rows.filter((day >= "2024-01-11") & (day < "2024-01-21")), rows.filter(day >= "2024-01-21")]
    out = None
    for sink, batches in (("storage", [0, 1, 1, 2]), ("search", [0, 2])):
        taken = {}
        for i in batches:
            taken[i] = accept_new(parts[i], root, sink, i, times[i], order=["ingested_at", "delivery"])
        for i, found in taken.items():
            one = found.select(F.lit(sink).alias("sink"), F.lit(i).alias("batch"), "tenant_id", "id")
            out = one if out is None else out.unionByName(one)
    return out


@query(
    "k3_fan_out",
    LOGS + "SELECT 'storage' AS sink, tenant_id, count(*) AS entries FROM logs GROUP BY 2 UNION ALL SELECT 'search', tenant_id, count(*) FROM logs GROUP BY 2",
)
def _(spark, sf):
    paths = {"storage": new_path(spark, "fan-storage"), "search": new_path(spark, "fan-search")}

    def broken(_):
        raise RuntimeError("sink is down")

    sinks = {
        "storage": lambda df: df.write.parquet(paths["storage"]),
        "broken": broken,
        "search": lambda df: df.select("tenant_id", "id", "message").write.parquet(paths["search"]),
    }
    failed = K.fan_out(entries(spark, sf), sinks)
    out = None
    for name, path in paths.items():
        if name in failed:
            continue
        part = spark.read.parquet(path).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("entries")).withColumn("sink", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "k4_quarantine",
    DTOS + f"""SELECT tenant_id, array_to_string(errors, '; ') AS reason, count(*) AS entries, TIMESTAMP '{AS_OF}' AS quarantined_at FROM validated WHERE len(errors) > 0 GROUP BY 1, 2""",
)
def _(spark, sf):
    rejected = validate_entries(dtos(spark, sf), AS_OF).filter("NOT is_valid")
    raw = F.to_json(F.struct("event_id", "source_id", "log_type", "level", "message"))
    path = new_path(spark, "quarantine")
    K.quarantine(rejected, F.col("errors"), raw, AS_OF).write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.groupBy("tenant_id", F.array_join("reason", "; ").alias("reason"), "quarantined_at").agg(F.count(F.lit(1)).alias("entries"))


@query("k5_delete_tenant", LOGS + "SELECT tenant_id, count(*) AS entries FROM logs WHERE tenant_id <> 'tenant-1' GROUP BY 1")
def _(spark, sf):
    root = new_path(spark, "by-tenant")
    logs(spark, sf).select("tenant_id", "id", "message").hint("rebalance", "tenant_id").write.partitionBy("tenant_id").parquet(root)
    K.delete_tenant(spark, root, "tenant-1")
    return spark.read.parquet(root).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("entries"))


@query("k5_without_tenant", LOGS + "SELECT id, tenant_id FROM logs WHERE tenant_id <> 'tenant-1'")
def _(spark, sf):
    return K.without_tenant(logs(spark, sf), "tenant-1").select("id", "tenant_id")


@query(
    "k6_apply_retention",
    """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-08-01' - INTERVAL 90 DAY THEN 'Cold' WHEN o_orderdate < TIMESTAMP '1998-08-01' - INTERVAL 30 DAY THEN 'InfrequentAccess'
      ELSE 'Standard' END AS storage_class FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 365 DAY""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "timestamp")
    return K.apply_retention(rows, "1998-08-01 00:00:00").select("o_orderkey", "storage_class")


@query("k6_drop_expired", LOGS + "SELECT tenant_id, count(*) AS entries FROM logs WHERE timestamp >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1")
def _(spark, sf):
    root = new_path(spark, "expiring")
    K.write_archive(entries(spark, sf), root)
    K.drop_expired(spark, root, dt.datetime(2024, 1, 26, 7), delete_after=10)
    return spark.read.parquet(root).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("entries"))


@query("k7_write_audit", LOGS + "SELECT tenant_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS audit_date, count(*) AS records FROM logs WHERE level = 'Fatal' GROUP BY 1, 2")
def _(spark, sf):
    path = new_path(spark, "audit")
    fired = logs(spark, sf).filter("level = 'Fatal'").select("tenant_id", F.col("timestamp").alias("at"), F.lit("alert").alias("kind"), F.to_json(F.struct("id", "message")).alias("record"))
    K.write_audit(fired, path)
    return spark.read.parquet(path).groupBy("tenant_id", F.col("audit_date").cast("string").alias("audit_date")).agg(F.count(F.lit(1)).alias("records"))


_HOURS = "SELECT count(DISTINCT (tenant_id, year, month, day, hour)) AS files FROM logs"


@query(
    "g7_scan_estimate",
    LOGS + f""", whole AS ({_HOURS}), part AS ({_HOURS} WHERE tenant_id = 'tenant-2' AND concat(year, month, day, hour) BETWEEN '2024010905' AND '2024012307')
    SELECT part.files, whole.files AS all_files, true AS reads_less FROM part, whole""",
)
def _(spark, sf):
    root = _archive(spark, sf)
    part, whole = scan_estimate(spark, root, "tenant-2", _FROM, _TO), scan_estimate(spark, root)
    both = part.withColumns({"all_files": whole.select("files").scalar(), "all_bytes": whole.select("estimated_bytes").scalar()})
    return both.select("files", "all_files", (F.col("estimated_bytes") < F.col("all_bytes")).alias("reads_less"))


# -- replay ------------------------------------------------------------------------


@query(
    "r1_replay_prefixes",
    """WITH jobs AS (SELECT o_orderkey AS job_id, concat('tenant-', CAST(o_custkey % 4 AS VARCHAR)) AS tenant_id, o_orderdate AS t_from, o_orderdate + to_days(CAST(o_orderkey % 100 AS INTEGER)) AS t_to FROM orders)
    SELECT job_id, tenant_id, concat('logs/', tenant_id, '/', strftime(unnest(generate_series(date_trunc('month', t_from)::TIMESTAMP, date_trunc('month', t_to)::TIMESTAMP, INTERVAL 1 MONTH)), '%Y/%m'), '/') AS prefix FROM jobs""",
)
def _(spark, sf):
    jobs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("tenant-"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"),
        F.col("o_orderdate").alias("t_from"), F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 100 AS INT))").alias("t_to"),
    )
    return R.replay_prefixes(jobs)


_AGAIN = "2024-02-01 00:00:00"


@query(
    "r2_replay",
    LOGS + f"SELECT id, tenant_id, message, 'Replay' AS ingestion_mode, TIMESTAMP '{_AGAIN}' AS ingested_at FROM logs WHERE tenant_id = 'tenant-1' AND {_IN_RANGE}",
)
def _(spark, sf):
    rows = R.replay(spark, _archive(spark, sf), "tenant-1", _FROM, _TO, _AGAIN)
    return rows.select("id", "tenant_id", "message", "ingestion_mode", "ingested_at")


@query(
    "r2_replay_files",
    LOGS + f"SELECT 'Completed' AS status, 0 AS failed_files, count(*) AS entries, count(*) AS indexed FROM logs WHERE tenant_id = 'tenant-1' AND {_IN_RANGE}",
)
def _(spark, sf):
    """The journal of a job that is run twice; the second run finds every file done."""
    hot, journal = new_path(spark, "hot"), new_path(spark, "journal")
    for _ in range(2):
        outcome = R.replay_files(
            spark, _archive(spark, sf), "tenant-1", _FROM, _TO, _AGAIN, lambda rows: K.upsert_hot(rows, hot), journal, "job"
        )
    indexed = spark.read.parquet(hot).agg(F.count(F.lit(1)).alias("n")).scalar()
    return R.job_status(outcome).select("status", "failed_files", "entries", indexed.alias("indexed"))


@query(
    "k6_storage_moves",
    LOGS + """, m AS (SELECT tenant_id, id, CASE WHEN d >= 365 THEN 'Deleted' WHEN d >= 90 THEN 'Cold' WHEN d >= 30 THEN 'InfrequentAccess' ELSE 'Standard' END AS storage_class
      FROM (SELECT *, date_diff('day', timestamp::DATE, DATE '2025-01-15') AS d FROM logs))
    SELECT storage_class, tenant_id, count(*) AS entries FROM m WHERE storage_class <> 'Deleted' GROUP BY 1, 2
    UNION ALL SELECT concat('earlier ', CASE WHEN d >= 90 THEN 'Cold' WHEN d >= 30 THEN 'InfrequentAccess' ELSE 'Standard' END), tenant_id, count(*)
      FROM (SELECT *, date_diff('day', timestamp::DATE, DATE '2024-04-12') AS d FROM logs) GROUP BY 1, 2""",
)
def _(spark, sf):
    """The archive after a move in April, and after one in the next January, when its first days are a year old."""
    roots = {name: new_path(spark, f"class-{name}") for name in C.CLASS_AFTER}
    K.write_archive(entries(spark, sf), roots["Standard"])
    store = C.StorageClasses(spark, roots, new_path(spark, "manifest"))

    def counts(prefix):
        rows = store.rows().groupBy(F.concat(F.lit(prefix), "storage_class").alias("storage_class"), "tenant_id")
        return rows.agg(F.count(F.lit(1)).alias("entries")).checkpoint()

    store.move(dt.datetime(2024, 4, 12))
    first = counts("earlier ")
    store.move(dt.datetime(2025, 1, 15))
    return first.unionByName(counts(""))


@query(
    "r3_reparse",
    LOGS + """SELECT id, upper(message) AS message, day, hour FROM logs WHERE tenant_id = 'tenant-1' AND timestamp >= TIMESTAMP '2024-01-09 05:00:00' AND timestamp < TIMESTAMP '2024-01-12 07:00:00'""",
)
def _(spark, sf):
    target = new_path(spark, "reparsed")
    fix = lambda df: df.withColumn("message", F.upper("message"))
    t_from, t_to = dt.datetime(2024, 1, 9, 5), dt.datetime(2024, 1, 12, 7)
    R.reparse(spark, _archive(spark, sf), target, fix, "tenant-1", t_from, t_to)
    return S.read_archive(spark, target, "tenant-1", t_from, t_to).select("id", "message", "day", "hour")


@query(
    "r4_replay_job",
    LOGS + """, r AS (SELECT * FROM logs WHERE tenant_id = 'tenant-1' AND timestamp >= TIMESTAMP '2024-01-09 05:00:00' AND timestamp < TIMESTAMP '2024-01-12 07:00:00')
    SELECT 'reindexed' AS step, count(*) AS produced FROM r UNION ALL SELECT 'reparsed', count(*) FROM r""",
)
def _(spark, sf):
    done = R.replay_job(
        spark, _archive(spark, sf), "tenant-1", dt.datetime(2024, 1, 9, 5), dt.datetime(2024, 1, 12, 7), _AGAIN,
        R.ReplayOptions(reindex_search=True, reparse_files=True, reprocess_alerts=False),
        hot_root=new_path(spark, "hot"), reparsed_root=new_path(spark, "reparsed"),
    )
    out = None
    for step, rows in done.items():
        part = rows.agg(F.count(F.lit(1)).alias("produced")).withColumn("step", F.lit(step))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "r4_replay_alerts",
    LOGS + ", " + RULES + """, w AS (SELECT r.rule_id, floor(date_diff('second', TIMESTAMP '2024-01-09 05:00:00', l.timestamp) / (60.0 * window_minutes)) AS k,
        count(*) AS n, sum(duration_ms) AS s, avg(duration_ms) AS a, max(duration_ms) AS mx
      FROM rules r JOIN logs l ON l.tenant_id = r.tenant_id AND (r.log_type IS NULL OR r.log_type = l.log_type) AND (r.level IS NULL OR r.level = l.level)
      WHERE r.is_enabled AND timestamp >= TIMESTAMP '2024-01-09 05:00:00' AND timestamp < TIMESTAMP '2024-01-16 05:00:00' GROUP BY ALL),
    grid AS (SELECT rule_id, measure, threshold_value, threshold_operator,
        unnest(range(0, CAST(ceil(date_diff('second', TIMESTAMP '2024-01-09 05:00:00', TIMESTAMP '2024-01-16 05:00:00') / (60.0 * window_minutes)) AS BIGINT))) AS k
      FROM rules WHERE is_enabled),
    valued AS (SELECT rule_id, threshold_value, threshold_operator, CASE measure WHEN 'count' THEN coalesce(n, 0) WHEN 'sum' THEN s WHEN 'avg' THEN a ELSE mx END AS v FROM grid LEFT JOIN w USING (rule_id, k))
    SELECT rule_id, count(*) AS fired FROM valued WHERE CASE trim(threshold_operator) WHEN '>' THEN v > threshold_value WHEN '<' THEN v < threshold_value WHEN '>=' THEN v >= threshold_value
      WHEN '<=' THEN v <= threshold_value WHEN '==' THEN v = threshold_value WHEN '=' THEN v = threshold_value ELSE false END GROUP BY 1""",
)
def _(spark, sf):
    """A job for each tenant; each tenant's rules have a measure of their own. The archived tags hold the durations."""

    def timed(path):
        tag = F.create_map(F.lit("duration_ms"), F.col("duration_ms").cast("string"))
        rows = logs(spark, sf).withColumns({"tags": F.map_concat("tags", tag), "ingested_at": F.col("ingested_at").cast("timestamp")})
        K.write_archive(rows.select(*LOG_ENTRY.fieldNames()), path)

    root, out = _once(spark, sf, "timed-archive", timed), None
    for tenant in (f"tenant-{i}" for i in range(4)):
        done = R.replay_job(
            spark, root, tenant, dt.datetime(2024, 1, 9, 5), dt.datetime(2024, 1, 16, 5), _AGAIN,
            R.ReplayOptions(reindex_search=False, reprocess_alerts=True), rules=rules(spark, sf),
        )
        out = done["alerts"] if out is None else out.unionByName(done["alerts"])
    return out.groupBy("rule_id").agg(F.count(F.lit(1)).alias("fired"))


@query(
    "r5_replay_progress",
    LOGS + """, p AS (SELECT tenant_id AS job_id, count(*) AS processed_count, count(*) FILTER (level = 'Fatal') AS error_count FROM logs GROUP BY 1)
    SELECT job_id, processed_count, error_count, round(least(100.0 * processed_count / 20000, 100.0) + 1e-9, 6) AS progress_percent, round(processed_count / 600 + 1e-9, 6) AS entries_per_second,
      CAST(ceil(greatest(20000 - processed_count, 0) / (processed_count / 600)) AS BIGINT) AS remaining_seconds FROM p""",
)
def _(spark, sf):
    rows = logs(spark, sf)
    processed = rows.select(F.col("tenant_id").alias("job_id"), (F.col("level") == "Fatal").alias("is_error"))
    start = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz").alias("started_at")
    jobs = rows.select(F.col("tenant_id").alias("job_id")).distinct().select("job_id", start, F.lit(20_000).alias("estimated_total"))
    out = R.replay_progress(processed, jobs, "2024-01-31 00:10:00")
    return out.withColumns({"progress_percent": rounded(F.col("progress_percent").cast("double")), "entries_per_second": rounded("entries_per_second")})
