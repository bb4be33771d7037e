"""A stream that has read everything gives what the batch operator gives."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglake import schema
from loglake.operators.dedup import duplicates
from loglake.operators.ingest import validate_entries
from loglake.plans import all_queries
from loglake.session import new_path
from loglake.sinks import tables as K
from loglake.sources.files import STREAMED
from loglake.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
ROW = "tenant_id string, id string, source_id string, level string, timestamp timestamp, ingested_at timestamp"


@pytest.fixture
def landed(spark):
    """Files that land one after the other, with copies of earlier rows in later files."""
    path = new_path(spark, "landed")
    for f in range(4):
        rows = [
            (f"t{i % 3}", "hot" if i % 3 == 0 else f"e{f % 2}-{i}", f"s{i % 2}", "Error", T0 + dt.timedelta(minutes=10 * f + i % 10), T0 + dt.timedelta(minutes=10 * f))
            for i in range(60)
        ]
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return J.file_stream(spark, path, spark.read.parquet(path).schema, max_files=1)


@pytest.mark.parametrize("spread", [True, False])
def test_dedup_over_several_batches(spark, landed, spread):
    out = new_path(spark, "out")
    once = J.dedup_stream(stream(spark, landed), "24 hours", spread=spread)
    J.for_each_batch(once, lambda b, i: J.write_batch(b, out, i), new_path(spark, "ckpt")).awaitTermination()
    got = spark.read.parquet(out)
    assert duplicates(got).count() == 0
    assert got.count() == spark.read.parquet(landed).select("tenant_id", "id").distinct().count()


def per_window(rows):
    w = F.window("timestamp", "5 minutes")
    return rows.groupBy(w.alias("w"), "source_id").agg(F.count(F.lit(1)).alias("n")).select("w.start", "source_id", "n")


def test_view_in_complete_mode_equals_batch(spark, landed):
    out = new_path(spark, "view")
    J.view_stream(stream(spark, landed), per_window, out, new_path(spark, "ckpt"), mode="complete").awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(per_window(spark.read.parquet(landed)).collect())


def test_view_in_append_mode_writes_closed_windows_once(spark, landed):
    out = new_path(spark, "view")
    J.view_stream(stream(spark, landed), per_window, out, new_path(spark, "ckpt"), delay="0 seconds").awaitTermination()
    got, batch = spark.read.parquet(out).collect(), per_window(spark.read.parquet(landed)).collect()
    newest = max(r.start for r in batch)
    assert sorted(got) == sorted(r for r in batch if r.start < newest)


def test_a_restart_adds_nothing(spark, landed):
    out, ckpt = new_path(spark, "pull"), new_path(spark, "ckpt")
    for _ in range(2):
        J.pull_stream(stream(spark, landed), "job", out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 240


def test_a_repeated_batch_replaces_itself(spark):
    out = new_path(spark, "batches")
    for n in (3, 5):
        J.write_batch(spark.range(n), out, 7)
    assert spark.read.parquet(out).count() == 5


def test_hot_store_upsert_is_repeatable_and_moves_rows(spark):
    root = new_path(spark, "hot")

    def batch(level, day, minute):
        at = T0 + dt.timedelta(minutes=minute)
        return spark.createDataFrame([("t", "a", level, T0 + dt.timedelta(days=day), at)], "tenant_id string, id string, level string, timestamp timestamp, ingested_at timestamp")

    first, second = batch("Error", 0, 0), batch("Fatal", 3, 1)
    for b in (first, second, second, first):
        K.upsert_hot(b, root)
    rows = spark.read.parquet(root).collect()
    assert [(r.level, str(r.event_date)) for r in rows] == [("Fatal", "2024-01-04")]


def test_delete_tenant_leaves_others(spark):
    root = new_path(spark, "tenants")
    spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, n int").write.partitionBy("tenant_id").parquet(root)
    K.delete_tenant(spark, root, "a")
    assert [r.tenant_id for r in spark.read.parquet(root).collect()] == ["b"]
    with pytest.raises(ValueError):
        K.delete_tenant(spark, root, "../x")


def test_late_rows_agree_with_validation(spark):
    rows = [(i, T0 + dt.timedelta(hours=i)) for i in range(-800, 30, 7)]
    df = spark.createDataFrame(rows, "n int, timestamp timestamp")
    on_time, late = J.late_split(df, str(T0))
    assert on_time.count() + late.count() == len(rows)
    dto = on_time.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.LOG_ENTRY_DTO if f.name != "timestamp"})
    assert not [e for r in validate_entries(dto, str(T0)).collect() for e in r.errors if e.startswith("timestamp")]


def test_quota_counts_every_sliding_window(spark):
    times = [T0 + dt.timedelta(seconds=s) for s in list(range(0, 60, 2)) + [200]]
    df = spark.createDataFrame([("t", t) for t in times], "tenant_id string, timestamp timestamp")
    got = {r.window_start: r.requests for r in J.over_quota(df, 10).collect()}
    want = {}
    for k in range(-3, 20):
        start = T0 + dt.timedelta(seconds=15 * k)
        n = sum(start <= t < start + dt.timedelta(seconds=60) for t in times)
        if n > 10:
            want[start] = n
    assert got == want


def test_a_tenant_hour_is_not_divided_over_the_whole_shuffle(spark):
    """Files follow the rows, not the number of shuffle partitions."""
    landed, root = new_path(spark, "landed"), new_path(spark, "archive")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.LOG_ENTRY_DTO)
    row = {"source_id": "svc", "log_type": "Application", "level": "Information", "environment": "prod", "timestamp": T0, "message": "m"}
    rows = [tuple(({"id": f"e{i}"} | row).get(f.name) for f in schema.LOG_ENTRY_DTO) for i in range(400)]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(landed)
    incoming = J.file_stream(spark, landed, spark.read.parquet(landed).schema)
    J.ingest_stream(incoming, F.lit("t"), str(T0), None, root, new_path(spark, "ckpt")).awaitTermination()
    files = spark.read.parquet(f"{root}/{STREAMED}").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 400 and len(files) <= J.HOUR_TASKS < int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_registered_streams_exist():
    assert [n for n in all_queries()[0] if n.startswith("t")]
