from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglake import schema
from loglake.operators import ingest as I

NOW = dt.datetime(2026, 3, 25, 12)
AS_OF = "2026-03-25 12:00:00"
METRIC = ("http-latency", "ms", 12.5, "Histogram")


def dto(**change):
    row = {
        "id": None, "source_id": "payment-service", "log_type": "Application", "level": "Information",
        "environment": "production", "category": "api", "timestamp": NOW, "message": "ok", "trace_id": None,
        "stack_trace": None, "tags": None, "metric": None,
    }
    return tuple({**row, **change}[f] for f in schema.LOG_ENTRY_DTO.fieldNames())


CASES = {
    "valid": ({}, []),
    "empty message": ({"message": ""}, ["message is empty"]),
    "blank message": ({"message": " \t "}, ["message is empty"]),
    "longest message": ({"message": "x" * 65536}, []),
    "long message": ({"message": "x" * 65537}, ["message is too long"]),
    "empty source": ({"source_id": ""}, ["source_id is empty", "source_id has invalid characters"]),
    "source with a space": ({"source_id": "a b"}, ["source_id has invalid characters"]),
    "long source": ({"source_id": "a" * 257}, ["source_id is too long"]),
    "minimum timestamp": ({"timestamp": dt.datetime(1, 1, 1)}, ["timestamp is too old"]),
    "no timestamp": ({"timestamp": None}, ["timestamp is empty"]),
    "five minutes ahead": ({"timestamp": NOW + dt.timedelta(minutes=5)}, []),
    "six minutes ahead": ({"timestamp": NOW + dt.timedelta(minutes=6)}, ["timestamp is in the future"]),
    "thirty days old": ({"timestamp": NOW - dt.timedelta(days=30)}, ["timestamp is too old"]),
    "lower case enums": ({"log_type": "application", "level": "WARNING"}, []),
    "unknown level": ({"level": "Loud"}, ["level is unknown"]),
    "missing level": ({"level": None}, ["level is empty", "level is unknown"]),
    "long environment": ({"environment": "e" * 65}, ["environment is too long"]),
    "fifty tags": ({"tags": {f"k{i}": "v" for i in range(50)}}, []),
    "too many tags": ({"tags": {f"k{i}": "v" for i in range(51)}}, ["too many tags"]),
    "long key": ({"tags": {"k" * 129: "v"}}, ["tag key is too long"]),
    "long value": ({"tags": {"k": "v" * 1025}}, ["tag value is too long"]),
    "valid metric": ({"log_type": "Metric", "metric": METRIC}, []),
    "metric without payload": ({"log_type": "metric"}, ["metric is missing"]),
    "empty metric name": ({"log_type": "Metric", "metric": ("", "ms", 1.0, "Gauge")}, ["metric name is empty"]),
    "empty metric unit": ({"log_type": "Metric", "metric": ("m", " ", 1.0, "Gauge")}, ["metric unit is empty"]),
    "two problems": ({"message": "", "level": "Loud"}, ["level is unknown", "message is empty"]),
}


def test_validation_cases(spark):
    names = list(CASES)
    rows = [(n, *dto(**CASES[n][0])) for n in names]
    kind = schema.T.StructType([schema.T.StructField("case", schema.T.StringType())] + schema.LOG_ENTRY_DTO.fields)
    got = {r["case"]: r["errors"] for r in I.validate_entries(spark.createDataFrame(rows, kind), AS_OF).select("case", "errors").collect()}
    assert got == {n: CASES[n][1] for n in names}


def test_system_fields_are_never_taken_from_the_client(spark):
    df = spark.createDataFrame([dto(log_type="metric", level="warn", metric=("m", "ms", 1.0, "GAUGE"))], schema.LOG_ENTRY_DTO)
    row = I.to_entries(df, "tenant-abc", "Pull", AS_OF).first()
    assert (row.tenant_id, row.ingestion_mode, row.schema_version) == ("tenant-abc", "Pull", 1)
    assert (row.log_type, row.level, row.metric.metric_type) == ("Metric", "Warning", "Gauge")
    assert row.tags == {} and row.timestamp_unix_ms == int(NOW.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert row.ingested_at == NOW


def test_ids_repeat_on_retry_and_differ_between_entries(spark):
    rows = [dto(), dto(), dto(message="other"), dto(id="client-id")]
    ids = [r.id for r in I.to_entries(spark.createDataFrame(rows, schema.LOG_ENTRY_DTO), "t", "Push", AS_OF).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[3] == "client-id"
    assert len(ids[0]) == 32 and ids[0][12] == "7"


def test_archive_round_trip(spark):
    entry = spark.createDataFrame(
        [dto(tags={"test-key": "test-value"}, trace_id="t"), dto(category=None, tags=None)], schema.LOG_ENTRY_DTO
    )
    entries = I.to_entries(entry, "tenant-1", "Push", AS_OF)
    flat = I.to_archive_rows(entries)
    assert flat.columns == schema.ARCHIVE_ROW.fieldNames()
    assert '"test-key":"test-value"' in flat.filter("TraceId = 't'").first()["Tags"]
    back = I.from_archive_rows(flat, "fallback", AS_OF)
    kept = ["id", "source_id", "log_type", "level", "environment", "category", "timestamp_unix_ms", "message", "trace_id", "tags", "tenant_id"]
    assert sorted(map(str, back.select(kept).collect())) == sorted(map(str, entries.select(kept).collect()))
    assert {r.ingestion_mode for r in back.collect()} == {"Replay"}


@pytest.mark.parametrize("mode", ["Push", "Pull"])
def test_documents_round_trip(spark, mode):
    entries = I.to_entries(spark.createDataFrame([dto(tags={"a": "b"})], schema.LOG_ENTRY_DTO), "t", mode, AS_OF)
    docs = I.to_documents(entries)
    assert len(docs.columns) == 16
    back = I.from_documents(docs).first()
    assert (back.level, back.log_type, back.ingestion_mode) == ("Information", "Application", mode)
    odd = I.from_documents(docs.withColumns({"level": F.lit("x"), "log_type": F.lit(None).cast("string")})).first()
    assert (odd.level, odd.log_type) == ("Information", "Application")


def test_partition_path(spark):
    row = I.with_partitions(I.to_entries(spark.createDataFrame([dto()], schema.LOG_ENTRY_DTO), "t-1", "Push", AS_OF)).first()
    assert row.partition_path == "t-1/2026/03/25/12"
