"""Writing entries: the archive, the hot store, quarantine and audit tables, retention."""

from __future__ import annotations

import datetime as dt
import re
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake import schema
from loglake.functions.columns import partition_parts, ts_lit
from loglake.operators.dedup import KEY, latest_by_key
from loglake.sources.files import STREAMED, archive_rows, path_exists, tenant_folder

_MIN_SIZE = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
HOT_PARTITIONS = ["tenant_id", "event_date"]


def _with_event_time(entries: DataFrame) -> DataFrame:
    if "timestamp" not in entries.columns:
        entries = entries.withColumn("timestamp", F.timestamp_millis("timestamp_unix_ms"))
    return entries.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


_writers_lock = threading.Lock()
_writers: dict[str, list] = {}  # by application: [number of writers, setting before]


@contextmanager
def _many_writers(spark: SparkSession):
    """Keep AQE from merging a rebalanced shuffle into a few tasks.

    Rows are already together by table partition, so more tasks make no more files; they only create
    them in parallel. Of writers at the same time the last one puts the setting back.
    """
    app = spark.sparkContext.applicationId
    with _writers_lock:
        held = _writers.setdefault(app, [0, spark.conf.get(_MIN_SIZE)])
        held[0] += 1
        spark.conf.set(_MIN_SIZE, "1KB")
    try:
        yield
    finally:
        with _writers_lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(_MIN_SIZE, _writers.pop(app)[1])


def write_archive(entries: DataFrame, root: str, mode: str = "append", max_rows_per_file: int = 0) -> None:
    """Parquet by tenant and hour of the event time.

    The rebalance hint shuffles by the partition columns, after which AQE splits a hot tenant-hour over
    several tasks, each writing files of advisory size.
    """
    rows = _with_event_time(entries)
    rows = rows.withColumns(partition_parts(F.col("timestamp")))
    names = [f.name for f in schema.LOG_ENTRY.fields if f.name != "tenant_id"]
    writer = (
        rows.select(*names, "timestamp", *schema.PARTITION_COLUMNS)
        .hint("rebalance", *schema.PARTITION_COLUMNS)
        .write.mode(mode)
        .option("maxRecordsPerFile", max_rows_per_file)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*schema.PARTITION_COLUMNS)
    )
    with _many_writers(entries.sparkSession):
        writer.parquet(root)


def compact_archive(spark: SparkSession, root: str, target: str, where: Column | None = None) -> None:
    """Rewrite the small files that frequent flushes leave, to a new table."""
    rows = archive_rows(spark, root, [root])
    write_archive(rows if where is None else rows.filter(where), target, mode="overwrite")


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


LOCATOR = "_locator"
LOCATOR_BUCKETS = 64


def _locator_bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(LOCATOR_BUCKETS)).cast("int").alias("bucket")


def _locate(spark: SparkSession, root: str) -> DataFrame | None:
    """tenant_id, id, bucket, event_date: where the hot store has each id. None for a new store; built for one without."""
    path = f"{root}/{LOCATOR}"
    if not path_exists(spark, path):
        if not path_exists(spark, root):
            return None
        rows = spark.read.parquet(root)
        _append_locator(rows.select(*KEY, "event_date", "ingested_at", "timestamp"), root)
    entries = spark.read.parquet(path)
    latest = F.max_by("event_date", F.struct("ingested_at", "timestamp"))
    return entries.groupBy("bucket", *KEY).agg(latest.alias("event_date"))


def _append_locator(rows: DataFrame, root: str) -> None:
    placed = rows.select("*", _locator_bucket()).hint("rebalance", "bucket")
    placed.write.mode("append").partitionBy("bucket").parquet(f"{root}/{LOCATOR}")


def compact_locator(spark: SparkSession, root: str) -> None:
    """One row per id again, after ids have moved between days. No other write may run."""
    path = f"{root}/{LOCATOR}"
    latest = latest_by_key(spark.read.parquet(path), ["bucket", *KEY], ["ingested_at", "timestamp"]).checkpoint()
    latest.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_hot(batch: DataFrame, root: str) -> int:
    """Last write wins per id, in a store partitioned by tenant and event day; returns the number of partitions read.

    A locator beside the store says which partition has an id, so that only partitions which the batch or an older
    version of one of its ids lives in are read and replaced; their names, no rows, pass through the driver. New rows
    are written before partitions that they left empty go, and the locator is written last, so a crash loses
    nothing; running the same batch again changes nothing and finishes what was left.
    """
    spark = batch.sparkSession
    rows = latest_by_key(
        _with_event_time(batch).withColumn("event_date", F.to_date("timestamp")), KEY, ["ingested_at", "timestamp"]
    ).checkpoint()
    places = rows.select(*KEY, _locator_bucket())
    located = _locate(spark, root)
    merged, old, existing = rows, None, []
    if located is not None:
        old = located.join(places, ["bucket", *KEY], "left_semi").checkpoint()
        touched = old.select(*HOT_PARTITIONS).union(rows.select(*HOT_PARTITIONS)).distinct().collect()
        folders = [f"{root}/{tenant_folder(spark, r.tenant_id)}/event_date={r.event_date}" for r in touched]
        existing = [f for f in folders if path_exists(spark, f)]
    if existing:
        current = spark.read.option("basePath", root).schema(rows.schema).parquet(*existing).select(*rows.columns)
        merged = latest_by_key(current.unionByName(rows), KEY, ["ingested_at", "timestamp"]).checkpoint()
    # Partitions whose last row moved away are not in `merged`, so overwriting would leave them behind.
    emptied = [] if old is None else old.select(*HOT_PARTITIONS).distinct().join(merged, HOT_PARTITIONS, "left_anti").collect()
    writer = (
        merged.hint("rebalance", *HOT_PARTITIONS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*HOT_PARTITIONS)
    )
    with _many_writers(spark):
        writer.parquet(root)
    for row in emptied:
        delete_path(spark, f"{root}/{tenant_folder(spark, row.tenant_id)}/event_date={row.event_date}")
    now = merged.join(places, KEY, "left_semi").select(*KEY, "event_date", "ingested_at", "timestamp")
    if old is not None:
        same = old.select(*KEY, F.col("event_date").alias("__old"))
        now = now.join(same, KEY, "left").where(~F.col("event_date").eqNullSafe(F.col("__old"))).drop("__old")
    _append_locator(now, root)
    return len(existing)


def fan_out(batch: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Hand one accepted batch to several sinks at once; returns the names of those that failed, with the error's text.

    The batch is kept for the duration so that it is computed once; each sink's jobs are submitted by a thread of its own, so
    a slow or failing sink does not keep the batch from the others. Sinks must accept the same batch twice; one that
    should not see an id again takes its rows through `sinks.seen.accept_new`, under its own name.
    """

    def run(write: Callable[[DataFrame], None]) -> str | None:
        try:
            write(batch)
        except Exception as failure:
            return f"{type(failure).__name__}: {failure}"

    batch.persist()
    try:
        with ThreadPoolExecutor(max(1, len(sinks))) as pool:
            errors = dict(zip(sinks, pool.map(run, sinks.values())))
    finally:
        batch.unpersist()
    return {name: error for name, error in errors.items() if error is not None}


def quarantine(rejected: DataFrame, reason: Column, raw: Column, at: dt.datetime | str | Column) -> DataFrame:
    """Rows for the quarantine table: raw text, reasons, when."""
    return rejected.select(
        F.col("tenant_id") if "tenant_id" in rejected.columns else F.lit(None).cast("string").alias("tenant_id"),
        raw.alias("raw"),
        reason.alias("reason"),
        (at if isinstance(at, Column) else F.lit(str(at)).cast("timestamp")).alias("quarantined_at"),
    )


def delete_tenant(spark: SparkSession, root: str, tenant: str) -> None:
    """Drop the tenant's partition directories, of batch jobs and streams; no other tenant's files are touched.

    Fails if there is none.
    """
    if not tenant.strip() or {".", ".."} & set(re.split(r"[/\\]", tenant)):
        raise ValueError("not a tenant id")
    paths = [f"{base}/{tenant_folder(spark, tenant)}" for base in (root, f"{root}/{STREAMED}")]
    stored = [p for p in paths if path_exists(spark, p)]
    if not stored:
        raise LookupError(f"nothing is stored for tenant {tenant!r}")
    for path in stored:
        delete_path(spark, path)


def without_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """All rows but the tenant's; rows without a tenant stay."""
    return df.filter(~F.col("tenant_id").eqNullSafe(tenant))


def apply_retention(
    df: DataFrame,
    as_of: dt.datetime | str,
    infrequent_after: int = 30,
    cold_after: int = 90,
    delete_after: int = 365,
) -> DataFrame:
    """Drop rows past the limit and name the storage class of the rest."""
    now = ts_lit(df, as_of)
    kept = df.filter(F.col("timestamp") >= now - F.expr(f"INTERVAL {delete_after} DAYS"))
    return kept.withColumn(
        "storage_class",
        F.when(F.col("timestamp") < now - F.expr(f"INTERVAL {cold_after} DAYS"), "Cold")
        .when(F.col("timestamp") < now - F.expr(f"INTERVAL {infrequent_after} DAYS"), "InfrequentAccess")
        .otherwise("Standard"),
    )


def drop_expired(spark: SparkSession, root: str, as_of: dt.datetime, delete_after: int = 365) -> int:
    """Delete the archive's day folders that lie wholly before the limit; returns their number.

    Only the partition columns are read. Results of queries, which are kept for seven days, go the same way.
    """
    day = F.to_date(F.concat_ws("-", "year", "month", "day"))
    days = archive_rows(spark, root, [root]).select("tenant_id", "year", "month", "day").distinct()
    old = days.filter(day < F.lit((as_of - dt.timedelta(days=delete_after)).date())).collect()
    for row in old:
        for base in (root, f"{root}/{STREAMED}"):
            path = f"{base}/{tenant_folder(spark, row.tenant_id)}/year={row.year}/month={row.month}/day={row.day}"
            if path_exists(spark, path):
                delete_path(spark, path)
    return len(old)


def write_audit(rows: DataFrame, root: str, at: str = "at") -> None:
    """Append immutable audit rows by tenant and day."""
    (
        rows.withColumn("audit_date", F.to_date(at))
        .hint("rebalance", "tenant_id", "audit_date")
        .write.mode("append")
        .partitionBy("tenant_id", "audit_date")
        .parquet(root)
    )
