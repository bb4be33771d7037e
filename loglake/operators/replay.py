"""Replay and backfill from the archive."""

from __future__ import annotations

import datetime as dt
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake import schema
from loglake.functions.columns import partition_parts, ts_lit
from loglake.operators.alerts import backtest_rules
from loglake.operators.filters import partition_range, time_range
from loglake.plans.logs_view import canonical_logs
from loglake.sinks.tables import delete_path, upsert_hot, write_archive
from loglake.sources.files import archive_rows, archive_schema, file_keys, key_column, path_exists, read_archive, tenant_folder


def replay_prefixes(jobs: DataFrame, root: str = "logs") -> DataFrame:
    """One path prefix per job and month touched by (`t_from`, `t_to`)."""
    months = F.sequence(
        F.date_trunc("month", "t_from"), F.date_trunc("month", "t_to"), F.expr("INTERVAL 1 MONTH")
    )
    rows = jobs.withColumn("m", F.explode(months))
    prefix = F.concat(F.lit(f"{root}/"), "tenant_id", F.lit("/"), F.date_format("m", "yyyy/MM"), F.lit("/"))
    return rows.select("job_id", "tenant_id", prefix.alias("prefix"))


def mark_replayed(logs: DataFrame, mode: str = "Replay", ingested_at: dt.datetime | str | None = None) -> DataFrame:
    rows = logs.withColumn("ingestion_mode", F.lit(mode))
    if ingested_at is not None:
        rows = rows.withColumn("ingested_at", ts_lit(logs, ingested_at, "ingested_at"))
    return rows


def replay(
    spark: SparkSession, root: str, tenant: str, t_from: dt.datetime, t_to: dt.datetime, ingested_at, mode: str = "Replay"
) -> DataFrame:
    """Archived entries of exactly ``[t_from, t_to)``, ready to be handed to the sinks again."""
    return mark_replayed(read_archive(spark, root, tenant, t_from, t_to), mode, ingested_at)


def reparse(
    spark: SparkSession, root: str, target: str, fix: Callable[[DataFrame], DataFrame], tenant: str,
    t_from: dt.datetime, t_to: dt.datetime,
) -> None:
    """Re-run a normalisation over whole hours and write them to `target`.

    The tenant's hours of `target` in the range are replaced; those that get no rows any more are removed, after the new
    rows are written. Give whole hours: an hour is the unit that is replaced.
    """
    rows = fix(read_archive(spark, root, tenant, t_from, t_to))
    write_archive(rows, target, mode="overwrite")
    hour = schema.PARTITION_COLUMNS
    there = archive_rows(spark, target, [target]).filter(F.col("tenant_id") == tenant)
    stored = partition_range(there, t_from, t_to).select(*hour).distinct()
    # Hours at the ends of the range may hold rows outside it; only whole hours are removed.
    start = F.to_timestamp(F.concat_ws("-", *hour[1:]), "yyyy-MM-dd-HH")
    whole = stored.filter((start >= F.lit(t_from)) & (start + F.expr("INTERVAL 1 HOUR") <= F.lit(t_to)))
    written = rows.withColumns(partition_parts(F.col("timestamp"))).select(*hour).distinct()
    for row in whole.join(written, hour, "left_anti").collect():
        parts = "/".join(f"{c}={row[c]}" for c in hour[1:])
        delete_path(spark, f"{target}/{tenant_folder(spark, row.tenant_id)}/{parts}")


JOURNAL = "job_id string, key string, status string, entries long, error string, attempt int"
_UNREADABLE = ("FAILED_READ_FILE", "CANNOT_READ_FILE", "PARQUET")


def replay_files(
    spark: SparkSession, root: str, tenant: str, t_from: dt.datetime, t_to: dt.datetime, ingested_at,
    handle: Callable[[DataFrame], None], journal: str, job_id: str, mode: str = "Replay",
) -> DataFrame:
    """Replay file by file, as a journal has it: key, status (Done or Failed), entries and error of every file of the job.

    ``handle`` gets the rows of all files that are not done yet at once; it must accept the same rows twice, as the sinks
    do. A file that cannot be read is recorded as Failed with its error, and the others are tried without it; a later
    run does only files that failed or are new. Rows never pass through the driver, names of files do.
    """
    attempt = 1 + (_journal(spark, journal).filter(F.col("job_id") == job_id).agg(F.max("attempt")).first()[0] or 0)
    done = _journal(spark, journal).filter((F.col("job_id") == job_id) & (F.col("status") == "Done")).select("key")
    base = f"{root}/{tenant_folder(spark, tenant)}"
    listed = file_keys(spark, base, "*.parquet") if path_exists(spark, base) else spark.createDataFrame([], "key string")
    pending = [r.key for r in _in_range(listed, t_from, t_to).join(done, "key", "left_anti").select("key").collect()]
    failed: dict[str, str] = {}
    while pending:
        read = spark.read.schema(archive_schema()).option("basePath", root).parquet(*pending)
        rows = time_range(canonical_logs(read), t_from, t_to)
        try:
            handle(mark_replayed(rows, mode, ingested_at))
            counted = rows.groupBy(key_column().alias("key")).agg(F.count(F.lit(1)).alias("entries"))
            found = spark.createDataFrame([(k,) for k in pending], "key string").join(counted, "key", "left").fillna(0, ["entries"])
            ok = found.select("key", F.lit("Done").alias("status"), "entries", F.lit(None).cast("string").alias("error"))
            _record(ok, journal, job_id, attempt)
            break
        except Exception as failure:
            broken = _named_file(failure, pending)
            if broken is None:
                raise
            failed[broken] = str(failure).splitlines()[0][:500]
            pending.remove(broken)
    if failed:
        bad = [(k, "Failed", 0, e) for k, e in sorted(failed.items())]
        _record(spark.createDataFrame(bad, "key string, status string, entries long, error string"), journal, job_id, attempt)
    return replay_outcome(spark, journal, job_id)


def replay_outcome(spark: SparkSession, journal: str, job_id: str) -> DataFrame:
    """The last outcome of every file of a job."""
    rows = _journal(spark, journal).filter(F.col("job_id") == job_id)
    last = rows.groupBy("key").agg(F.max_by(F.struct("status", "entries", "error"), "attempt").alias("r"))
    return last.select("key", "r.status", "r.entries", "r.error")


def job_status(outcome: DataFrame) -> DataFrame:
    """One row: Completed if no file failed, else Failed; files, failed files and entries."""
    bad = F.count_if(F.col("status") == "Failed")
    return outcome.agg(
        F.when(bad > 0, "Failed").otherwise("Completed").alias("status"), F.count(F.lit(1)).alias("files"),
        bad.alias("failed_files"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"),
    )


def _journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], JOURNAL)


def _record(rows: DataFrame, journal: str, job_id: str, attempt: int) -> None:
    named = rows.select(F.lit(job_id).alias("job_id"), "key", "status", "entries", "error", F.lit(attempt).alias("attempt"))
    named.write.mode("append").parquet(journal)


def _in_range(files: DataFrame, t_from: dt.datetime, t_to: dt.datetime) -> DataFrame:
    """Files of the hours that the range touches, by the names of their folders."""
    parts = [F.regexp_extract("key", f"/{name}=([^/]+)/", 1) for name in schema.PARTITION_COLUMNS[1:]]
    hour = F.concat(*parts)
    return files.filter((hour >= f"{t_from:%Y%m%d%H}") & (hour <= f"{t_to:%Y%m%d%H}"))


def _named_file(failure: Exception, pending: list[str]) -> str | None:
    """The file that a failed read names, in the failure or in one of its causes."""
    text, cause = str(failure), failure
    while (cause := cause.__cause__ or getattr(cause, "cause", None)) is not None:
        text += str(cause)
    if not any(word in text.upper() for word in _UNREADABLE):
        return None
    return next((k for k in pending if k in text or urllib.parse.quote(k) in text), None)


@dataclass(frozen=True)
class ReplayOptions:
    reindex_search: bool = True
    reprocess_alerts: bool = False
    reparse_files: bool = False
    override_parser: Callable[[DataFrame], DataFrame] | None = None


def replay_job(
    spark: SparkSession, root: str, tenant: str, t_from: dt.datetime, t_to: dt.datetime, ingested_at,
    options: ReplayOptions = ReplayOptions(), hot_root: str | None = None, reparsed_root: str | None = None,
    rules: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Send replayed rows where the options say; returns what each step produced."""
    rows = replay(spark, root, tenant, t_from, t_to, ingested_at)
    done: dict[str, DataFrame] = {}
    if options.reparse_files:
        fix = options.override_parser or (lambda df: df)
        rows = fix(rows)
        write_archive(rows, reparsed_root, mode="overwrite")
        done["reparsed"] = read_archive(spark, reparsed_root, tenant, t_from, t_to)
    if options.reindex_search:
        upsert_hot(rows, hot_root)
        done["reindexed"] = spark.read.parquet(hot_root).filter(F.col("tenant_id") == tenant)
    if options.reprocess_alerts and rules is not None:
        done["alerts"] = backtest_rules(rows, rules.filter(F.col("tenant_id") == tenant), t_from, t_to)
    return done


def replay_progress(processed: DataFrame, jobs: DataFrame, as_of: dt.datetime | str) -> DataFrame:
    """Counts, percent, rate and expected end per job.

    `processed` has one row per handled entry with `is_error`; `jobs` has started_at and estimated_total.
    """
    done = processed.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("processed_count"), F.count_if(F.col("is_error")).alias("error_count")
    )
    now = ts_lit(jobs, as_of, "started_at")
    rows = jobs.join(done, "job_id", "left").fillna(0, ["processed_count", "error_count"])
    elapsed = F.timestamp_diff("SECOND", F.col("started_at"), now)
    rate = F.col("processed_count") / F.nullif(elapsed, F.lit(0))
    left = F.greatest(F.col("estimated_total") - F.col("processed_count"), F.lit(0))
    return rows.select(
        "job_id",
        "processed_count",
        "error_count",
        F.least(100.0 * F.col("processed_count") / F.col("estimated_total"), F.lit(100.0)).alias("progress_percent"),
        rate.alias("entries_per_second"),
        F.ceil(left / F.nullif(rate, F.lit(0.0))).alias("remaining_seconds"),
    )
