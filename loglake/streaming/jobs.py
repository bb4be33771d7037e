"""Structured Streaming jobs around the batch operators.

The checkpoint takes the place of acknowledgements: a batch is done when its output is committed, and a
restart repeats the unfinished batch. Every `foreachBatch` writer below can be given a batch twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loglake import schema
from loglake.functions.columns import partition_parts, ts_lit
from loglake.operators.alerts import due_rules, evaluate_cells, evaluate_rules, evaluate_sql_rules, fired_events, rule_cells
from loglake.operators.dedup import KEY
from loglake.operators.ingest import split_valid, to_entries, validate_entries
from loglake.operators.search_index import index_batch, log_fields
from loglake.sinks.seen import accept_new
from loglake.sinks.tables import delete_path, quarantine, upsert_hot
from loglake.sources.files import STREAMED, path_exists

AVAILABLE_NOW = {"availableNow": True}
FLUSH_EVERY_5S = {"processingTime": "5 seconds"}
FLUSH_ROWS = 1000
# Tasks that write a batch's rows of one tenant-hour. A cluster's number of tasks would divide every hour to a few rows a file.
HOUR_TASKS = 4


def file_stream(
    spark: SparkSession, path: str, row_type: T.StructType, fmt: str = "parquet", glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Files of a directory as a stream; `max_files` per trigger bounds a micro-batch (back-pressure)."""
    reader = spark.readStream.schema(row_type).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def dedup_stream(df: DataFrame, ttl: str = "24 hours", ts: str = "ingested_at", spread: bool = True) -> DataFrame:
    """Drop ids already seen within `ttl` of ingest time.

    With `spread`, copies are first reduced within each input task's own bucket, so that the copies of
    one hot id do not all travel to the task that holds its state. Each sink that calls this on its own
    query has its own seen set.
    """
    rows = df.withWatermark(ts, ttl)
    if spread:
        rows = (
            rows.withColumn("__bucket", F.spark_partition_id() % 32)
            .dropDuplicatesWithinWatermark(["tenant_id", "id", "__bucket"])
            .drop("__bucket")
        )
    return rows.dropDuplicatesWithinWatermark(["tenant_id", "id"])


def ingest_stream(
    dtos: DataFrame, tenant: Column | str, as_of, ingested_at, root: str, checkpoint: str,
    ttl: str = "24 hours", trigger: dict = AVAILABLE_NOW, max_rows_per_file: int = 0, mode: str = "Push", spread: int = HOUR_TASKS,
) -> StreamingQuery:
    """Validate, normalise, de-duplicate and append to the archive. The file sink commits each batch once.

    `as_of` and `ingested_at` are the time of each batch unless given; the state of ids ends with that time.
    Streamed files live in a folder of their own below the root, whose commit log does not hide what batch jobs
    write; `read_archive` reads both. Rejected entries are the business of `quarantine_stream`, a second query on the
    same input. Rows are brought together by table partition to keep the number of files down; a tenant-hour is
    divided over up to `spread` tasks, since adaptive splitting does not apply to streams. Each of them writes files of
    its own, however few its rows.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    ingested_at = F.current_timestamp() if ingested_at is None else ingested_at
    accepted, _ = split_valid(validate_entries(dtos, as_of))
    entries = dedup_stream(to_entries(accepted, tenant, mode, ingested_at), ttl)
    rows = entries.withColumn("timestamp", F.timestamp_millis("timestamp_unix_ms"))
    rows = rows.withColumns(partition_parts(F.col("timestamp")))
    rows = rows.repartition(*schema.PARTITION_COLUMNS, F.pmod(F.xxhash64("id"), F.lit(spread)))
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/{STREAMED}")
        .option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", max_rows_per_file)
        .partitionBy(*schema.PARTITION_COLUMNS)
        .trigger(**trigger)
        .start()
    )


def search_branch(
    dtos: DataFrame, tenant: Column | str, as_of, ingested_at, hot: str, seen: str, checkpoint: str, index: str | None = None,
    ttl: str = "24 hours", trigger: dict = AVAILABLE_NOW, mode: str = "Push",
) -> StreamingQuery:
    """The other branch of ingest: accepted entries go to the hot store and, with ``index``, to the search index.

    A query of its own beside `ingest_stream`, with its own checkpoint and its own seen set (``seen``, under `search`), so
    neither branch waits for the other. Every step can be given a batch twice: the seen set answers a repeated batch as
    before, the hot store upserts, and the index replaces the batch's segment.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = as_of or spark.sql("SELECT CAST(current_timestamp() AS STRING) AS t").first()["t"]
        accepted, _ = split_valid(validate_entries(batch, F.lit(str(now)).cast("timestamp")))
        entries = to_entries(accepted, tenant, mode, F.lit(str(ingested_at or now)).cast("timestamp"))
        taken = accept_new(entries, seen, "search", batch_id, now, ttl, ["timestamp_unix_ms", "message"]).checkpoint()
        upsert_hot(taken, hot)
        if index is not None:
            index_batch(taken, index, batch_id, KEY, log_fields(taken))

    return for_each_batch(dtos, handle, checkpoint, trigger)


def flush_stream(dtos: DataFrame, tenant: Column | str, root: str, checkpoint: str, **options) -> StreamingQuery:
    """Ingest as a worker does: every five seconds, files of a thousand rows at most."""
    return ingest_stream(
        dtos, tenant, None, None, root, checkpoint, trigger=options.pop("trigger", FLUSH_EVERY_5S),
        max_rows_per_file=FLUSH_ROWS, **options,
    )


def quarantine_stream(
    dtos: DataFrame, raw: Column, as_of, root: str, checkpoint: str, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Rejected entries with their reasons, under their batch; each batch's counts are in the query's progress."""
    now = F.current_timestamp() if as_of is None else as_of
    rows = validate_entries(dtos, now).withColumn("__raw", raw)
    counted = rows.observe(
        "ingest", F.count_if(F.col("is_valid")).alias("accepted"), F.count_if(~F.col("is_valid")).alias("rejected")
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        at = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
        rejected = batch.filter("NOT is_valid").withColumn("__at", at)
        write_batch(quarantine(rejected, F.col("errors"), F.col("__raw"), F.col("__at")), root, batch_id)

    return for_each_batch(counted, handle, checkpoint, trigger)


def view_stream(
    logs: DataFrame, aggregate: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, delay: str = "10 minutes",
    mode: str = "append", trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Keep a windowed aggregate up to date.

    `append` writes each bucket once, when the watermark has passed it, and bounds the state; `complete`
    rewrites the whole result after every batch and suits small views.
    """
    rows = aggregate(logs.withWatermark("timestamp", delay))
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger)
    if mode == "complete":
        return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(root)).start()
    return writer.format("parquet").option("path", root).start()


def for_each_batch(
    rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def write_batch(batch: DataFrame, root: str, batch_id: int, *partitions: str, max_rows_per_file: int = 0) -> None:
    """Write under the batch's own partition; a repeated batch replaces what it wrote before."""
    (
        batch.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_rows_per_file)
        .partitionBy("batch_id", *partitions)
        .parquet(root)
    )


CELLS = (
    "tenant_id string, log_type string, level string, minute timestamp, on_minute boolean, n long, s double, c long, mx double, "
    "day date, batch_id long"
)


def write_cells(batch: DataFrame, root: str, batch_id: int) -> None:
    """Keep a batch's per-minute cells, by day; a repeated batch takes the place of its first try."""
    rows = rule_cells(batch).withColumn("day", F.to_date("minute")).withColumn("batch_id", F.lit(batch_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(root)


def read_cells(spark: SparkSession, root: str, as_of, minutes: int, upto: int | None = None) -> DataFrame:
    """Cells of the last `minutes` before `as_of`, of batches up to `upto`; other days are not opened."""
    rows = spark.read.schema(CELLS).parquet(root) if path_exists(spark, root) else spark.createDataFrame([], CELLS)
    now = F.lit(str(as_of)).cast("timestamp")
    rows = rows.filter(F.col("day").between(F.to_date(now - F.expr(f"INTERVAL {minutes + 1} MINUTES")), F.to_date(now)))
    return rows if upto is None else rows.filter(F.col("batch_id") <= upto)


def expire_cells(spark: SparkSession, root: str, as_of, minutes: int) -> int:
    """Delete the days that no rule's window of up to `minutes` reaches any more; returns their number."""
    limit = F.to_date(F.lit(str(as_of)).cast("timestamp") - F.expr(f"INTERVAL {minutes + 1} MINUTES"))
    old = spark.read.schema(CELLS).parquet(root).select("day").distinct().filter(F.col("day") < limit).collect()
    for row in old:
        delete_path(spark, f"{root}/day={row.day}")
    return len(old)


def alert_stream(
    logs: DataFrame, rules: DataFrame, as_of, root: str, checkpoint: str,
    store: Callable[[], DataFrame] | None = None, trigger: dict = AVAILABLE_NOW,
    evaluations: str | None = None, sql_rules: list[Row] | None = None, cells: str | None = None,
) -> StreamingQuery:
    """When a batch arrives, evaluate the enabled rules of its tenants and keep the fired events.

    `as_of` is the time of the batch unless given. With `cells`, a folder, the stream keeps per-minute cells of what it has
    seen, rules are evaluated from them at whole minutes, and days that no window reaches are dropped: a batch reads
    cells, never logs. Otherwise rules look at `store` (the archive, which `evaluate_rules` cuts to the longest window),
    or at the batch alone when there is none. With `evaluations`, a folder that keeps when each rule ran, only rules that are
    due are evaluated, `sql_rules` (which need `rule_id` and, for that, `evaluation_interval_seconds`) included; these
    look at `store` or the batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = as_of or spark.sql("SELECT CAST(current_timestamp() AS STRING) AS t").first()["t"]
        tenants = batch.select("tenant_id").distinct()
        mine, asked = rules.join(tenants, "tenant_id", "left_semi"), sql_rules or []
        if evaluations is not None:
            last = _last_runs(spark, evaluations, batch_id)
            mine = due_rules(mine, last, now)
            asked = _due_sql(spark, asked, last, now)
        seen = batch if store is None else store().join(tenants, "tenant_id", "left_semi")
        if cells is None:
            evaluated = evaluate_rules(seen, mine, now)
        else:
            write_cells(batch, cells, batch_id)
            longest = rules.filter("is_enabled").agg(F.coalesce(F.max("window_minutes"), F.lit(0)).alias("m")).first()["m"]
            evaluated = evaluate_cells(read_cells(spark, cells, now, longest, batch_id), mine, now)
            expire_cells(spark, cells, now, longest)
        events = fired_events(evaluated, now)
        if asked:
            more = fired_events(evaluate_sql_rules(spark, seen, asked), now)
            events = events.unionByName(more, allowMissingColumns=True)
        write_batch(events, root, batch_id)
        if evaluations is not None:
            at = F.lit(str(now)).cast("timestamp").alias("evaluated_at")
            ran = mine.select("tenant_id", "rule_id", at)
            if asked:
                names = [(r["tenant_id"], r["rule_id"]) for r in asked]
                ran = ran.unionByName(spark.createDataFrame(names, "tenant_id string, rule_id string").select("*", at))
            write_batch(ran, evaluations, batch_id)

    return for_each_batch(logs, handle, checkpoint, trigger)


def _due_sql(spark: SparkSession, asked: list[Row], last: DataFrame, now) -> list[Row]:
    """Those of a short list of SQL rules whose interval has passed; a rule without one is always due."""
    if not asked:
        return []
    every = [(i, r["tenant_id"], r["rule_id"], (r.asDict().get("evaluation_interval_seconds") or 0), True) for i, r in enumerate(asked)]
    frame = spark.createDataFrame(every, "place int, tenant_id string, rule_id string, evaluation_interval_seconds int, is_enabled boolean")
    due = {r.place for r in due_rules(frame, last, now).select("place").collect()}
    return [r for i, r in enumerate(asked) if i in due]


def _last_runs(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """Last run of each rule before this batch; a repeated batch does not see its own first try."""
    names = "tenant_id string, rule_id string, evaluated_at timestamp"
    if not path_exists(spark, root):
        return spark.createDataFrame([], names)
    rows = spark.read.schema(f"{names}, batch_id long").parquet(root).filter(F.col("batch_id") < batch_id)
    return rows.groupBy("tenant_id", "rule_id").agg(F.max("evaluated_at").alias("evaluated_at"))


def late_split(df: DataFrame, as_of, future: str = "5 MINUTES", past: str = "30 DAYS", col: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(rows in time, late or early rows with `lateness`) for a side table."""
    now = ts_lit(df, as_of, col)
    lateness = F.when(F.col(col) <= now - F.expr(f"INTERVAL {past}"), "late").when(
        F.col(col) > now + F.expr(f"INTERVAL {future}"), "future"
    )
    marked = df.withColumn("lateness", lateness)
    return marked.filter("lateness IS NULL").drop("lateness"), marked.filter("lateness IS NOT NULL")


PULL_ROWS = 500


def pull_stream(
    rows: DataFrame, tenant: str | None, root: str, checkpoint: str, trigger: dict = AVAILABLE_NOW, counts: str | None = None
) -> StreamingQuery:
    """Pulled files to the ingest table, in files of 500 rows at most, counting rows while they pass.

    With `counts`, a folder, each batch leaves a row there: entries, last event and how long it took.
    """
    if tenant is not None:
        rows = rows.withColumn("tenant_id", F.lit(tenant))
    counted = rows.observe("pulled", F.count(F.lit(1)).alias("entries"), F.max("timestamp").alias("last_event"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        start = time.monotonic()
        write_batch(batch, root, batch_id, max_rows_per_file=PULL_ROWS)
        if counts is not None:
            written = batch.sparkSession.read.parquet(f"{root}/batch_id={batch_id}")
            row = written.agg(F.count(F.lit(1)).alias("entries"), F.max("timestamp").alias("last_event"))
            write_batch(row.withColumn("seconds", F.lit(time.monotonic() - start)), counts, batch_id)

    return for_each_batch(counted, handle, checkpoint, trigger)


def tenant_batches(rows: DataFrame, root: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Each micro-batch grouped by tenant on its way to the hot store; a hot tenant is split by AQE."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.hint("rebalance", "tenant_id"), root, batch_id, "tenant_id")

    return for_each_batch(rows, handle, checkpoint, trigger)


# Requests a tenant may make in one minute. Ingest is a bucket of 1000 refilled by 500 a second.
QUERY_LIMIT_PER_MINUTE = 100
INGEST_LIMIT_PER_MINUTE = 1000 + 500 * 60


def over_quota(requests: DataFrame, limit: int = QUERY_LIMIT_PER_MINUTE, window: int = 60, segments: int = 4, ts: str = "timestamp") -> DataFrame:
    """Sliding windows in which a tenant made more than `limit` requests.

    Requests are counted per segment first; only those counts are spread over the windows they are in.
    """
    step = window // segments
    seg = F.window(ts, f"{step} seconds")["start"]
    per_segment = requests.groupBy("tenant_id", seg.alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    offsets = F.explode(F.array(*[F.lit(-i * step) for i in range(segments)]))
    spread = per_segment.withColumn("__o", offsets)
    start = F.col("segment") + F.expr("INTERVAL 1 SECOND") * F.col("__o")
    windows = spread.groupBy("tenant_id", start.alias("window_start")).agg(F.sum("n").alias("requests"))
    return windows.filter(F.col("requests") > limit)
