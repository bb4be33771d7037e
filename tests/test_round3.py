"""Selection by digits, stretches of an id's occurrences, and copies that nothing tells apart."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loglake.operators import alerts as L
from loglake.operators import dedup as D
from loglake.operators import matviews as M
from loglake.operators import replay as R
from loglake.operators.aggregates import exact_percentile, ordered_bits
from loglake.plans.fixtures import entries
from loglake.session import new_path
from loglake.sinks import storage_classes as C
from loglake.sinks import tables as K
from loglake.sources.files import path_exists, read_archive
from loglake.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
ODD = [0.0, -0.0, 1.0, -1.0, 2.0**-1074, -(2.0**-1074), 2.0**-1022, 1.7976931348623157e308, -1e300, 0.1, 1 / 3, 1024.0, 1023.9999999999999, 3.5e-310]


def test_ordered_bits_are_the_bits(spark):
    rng = np.random.default_rng(1)
    values = ODD + [float(x) for x in rng.standard_normal(300) * 10.0 ** rng.integers(-300, 300, 300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("k")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (-bits if r.v < 0 else bits)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_percentile_of_any_doubles(spark, q):
    """All magnitudes in one group, one value only in another, a null group, and a group of one row."""
    rng = random.Random(2)
    rows = [("wide", rng.choice(ODD[:6] + ODD[8:])) for _ in range(500)]
    rows += [("wide", rng.uniform(-1, 1) * 10 ** rng.randint(-250, 250)) for _ in range(500)]
    rows += [("same", 7.5)] * 400 + [(None, float(i % 9)) for i in range(100)] + [("one", 3.0), ("none", None)]
    got = {r.g: r.percentile for r in exact_percentile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", q).collect()}
    for g in ("wide", "same", None, "one"):
        want = np.quantile([v for k, v in rows if k == g], q)
        assert got[g] == pytest.approx(want, rel=1e-12, abs=1e-300)
    assert set(got) == {"wide", "same", None, "one"}


def test_percentile_of_whole_numbers_and_of_all_rows(spark):
    df = spark.range(100_000).select((F.col("id") * F.col("id") - 5_000_000_000).alias("v"))
    want = np.quantile(np.arange(100_000) ** 2 - 5_000_000_000, 0.37)
    assert exact_percentile(df, [], "v", 0.37).first().percentile == pytest.approx(want)
    plan = exact_percentile(df, [], "v", 0.37)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_chains_and_stretches(spark):
    """Ids with long chains, with one, with gaps of exactly the time-to-live, and a hot one."""
    ttl, rng = 60, random.Random(5)
    times = {"chain": list(range(0, 300, 7)), "gap": [0, 60, 120, 121, 180, 240], "burst": [5] * 20, "pair": [0, 59, 600, 659]}
    times["hot"] = [rng.randrange(400) for _ in range(300)]
    rows = [(k, m) for k, ms in times.items() for m in ms]
    df = spark.createDataFrame([("t", k, T0 + dt.timedelta(minutes=m), i) for i, (k, m) in enumerate(rows)], "tenant_id string, id string, ingested_at timestamp, delivery long")
    until, want = {}, set()
    for i, (key, m) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        if m >= until.get(key, m):
            until[key] = m + ttl
            want.add(i)
    got = D.mark_first_seen(df, "60 MINUTES", tie=["delivery"]).collect()
    assert {r.delivery for r in got if r.is_new} == want and len(got) == len(rows)


def test_one_of_equal_rows_is_new(spark, monkeypatch):
    monkeypatch.setattr(D, "COPIES", 10)
    rows = [("t", "x", T0, {"a": "b"})] * 57 + [("t", "x", T0, {"a": "c"})] * 3 + [("t", "y", T0, None)] + [("t", "x", T0 + dt.timedelta(days=2), {})] * 2
    df = spark.createDataFrame(rows, "tenant_id string, id string, ingested_at timestamp, tags map<string,string>")
    got = D.mark_first_seen(df).collect()
    assert len(got) == len(rows) and sum(r.is_new for r in got) == 3
    plain = sorted(str((r.tenant_id, r.id, r.ingested_at, r.tags)) for r in got)
    assert plain == sorted(str(r) for r in rows)


def _rule_logs(spark):
    """Rows on, just before and just after minutes, by tenant, type and level."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        at = T0 + dt.timedelta(minutes=rng.randrange(200), microseconds=rng.choice([0, 0, 1, 30_000_000, 59_999_999]))
        rows.append((f"t{i % 2}", rng.choice(["Error", "Metric"]), rng.choice(["Error", "Fatal"]), at, rng.choice([None, float(rng.randrange(50))])))
    return spark.createDataFrame(rows, "tenant_id string, log_type string, level string, timestamp timestamp, duration_ms double")


def _some_rules(spark):
    rows = [
        (f"r{i}", f"t{i % 3}", f"rule {i}", m, lt, lv, w, ">", 3.0, True, 60)
        for i, (m, lt, lv, w) in enumerate((m, lt, lv, w) for m in ("count", "sum", "avg", "max") for lt in (None, "Error") for lv in (None, "Fatal") for w in (1, 7, 90))
    ]
    return spark.createDataFrame(rows, "rule_id string, tenant_id string, name string, measure string, log_type string, level string, window_minutes int, threshold_operator string, threshold_value double, is_enabled boolean, evaluation_interval_seconds int")


def test_rules_from_cells_are_rules_from_logs(spark):
    logs, rules = _rule_logs(spark), _some_rules(spark)
    for minute in (0, 50, 120, 300):
        now = str(T0 + dt.timedelta(minutes=minute))
        want = sorted((r.rule_id, r.actual_value, r.status) for r in L.evaluate_rules(logs, rules, now).collect())
        got = sorted((r.rule_id, r.actual_value, r.status) for r in L.evaluate_cells(L.rule_cells(logs), rules, now).collect())
        assert got == want


def test_cells_of_batches_repeats_and_expiry(spark):
    logs, rules, root = _rule_logs(spark), _some_rules(spark), new_path(spark, "cells")
    late = logs.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 3 DAYS"))
    for batch_id, batch in ((0, logs), (1, late), (1, late)):
        J.write_cells(batch, root, batch_id)
    now = str(T0 + dt.timedelta(days=3, minutes=120))
    want = sorted((r.rule_id, r.actual_value) for r in L.evaluate_rules(logs.unionByName(late), rules, now).collect())
    got = sorted((r.rule_id, r.actual_value) for r in L.evaluate_cells(J.read_cells(spark, root, now, 90), rules, now).collect())
    assert got == want
    assert L.evaluate_cells(J.read_cells(spark, root, now, 90, upto=0), rules, now).filter("actual_value > 0").count() == 0
    assert J.expire_cells(spark, root, now, 90) == 1
    assert sorted((r.rule_id, r.actual_value) for r in L.evaluate_cells(J.read_cells(spark, root, now, 90), rules, now).collect()) == want


def test_sql_rules_run_when_due(spark):
    logs, root, runs = _rule_logs(spark), new_path(spark, "fired"), new_path(spark, "runs")
    landed = new_path(spark, "landed")
    for _ in range(2):
        logs.coalesce(1).write.mode("append").parquet(landed)
    rule = Row(rule_id="s", tenant_id="t0", name="n", sql="SELECT count(*) FROM logs", threshold_operator=">", threshold_value=0.0, evaluation_interval_seconds=3600)
    stream = J.file_stream(spark, landed, logs.schema, max_files=1)
    now = str(T0 + dt.timedelta(minutes=200))
    J.alert_stream(stream, _some_rules(spark), now, root, new_path(spark, "ckpt"), evaluations=runs, sql_rules=[rule], cells=new_path(spark, "cells")).awaitTermination()
    fired = spark.read.parquet(root).filter("rule_id = 's'").collect()
    assert [(r.batch_id, r.actual_value) for r in fired] == [(0, float(logs.filter("tenant_id = 't0'").count()))]


def test_sketches_add_up_within_their_error(spark):
    rng = np.random.default_rng(6)
    values = np.sort(rng.lognormal(3, 1, 30_000))
    rows = [("t", T0 + dt.timedelta(seconds=int(i)), "s", "Metric", "http-latency", float(v)) for i, v in zip(rng.integers(0, 80_000, 30_000), values)]
    logs = spark.createDataFrame(rows, "tenant_id string, timestamp timestamp, source_id string, log_type string, category string, metric_value double")
    day = M.merge_sketches(M.latency_sketches(logs), bucket=F.date_trunc("day", "bucket"))
    got = M.sketch_percentiles(day, (0.1, 0.5, 0.95, 0.99)).first()
    for q, v in ((0.1, got.p10_ms), (0.5, got.p50_ms), (0.95, got.p95_ms), (0.99, got.p99_ms)):
        assert abs(np.searchsorted(values, v) / len(values) - q) < M.sketch_rank_error()
    assert got.entries == 30_000


def test_a_damaged_file_is_named_and_the_rest_is_done(spark):
    root, journal, hot = (new_path(spark, n) for n in ("archive", "journal", "hot"))
    rows = entries(spark, "/root/testdata/sf0.001").filter("tenant_id = 'tenant-1'")
    K.write_archive(rows, root)
    files = sorted(glob.glob(f"{root}/tenant_id=tenant-1/**/*.parquet", recursive=True))
    whole = open(files[3], "rb").read()
    damaged = spark.read.parquet(files[3]).count()
    open(files[3], "wb").write(whole[: len(whole) // 2])
    for crc in glob.glob(f"{os.path.dirname(files[3])}/.*.crc"):
        os.remove(crc)
    handled = []

    def handle(batch):
        K.upsert_hot(batch, hot)
        handled.append(batch.count())

    def run():
        outcome = R.replay_files(spark, root, "tenant-1", T0, T0 + dt.timedelta(days=40), "2024-03-01 00:00:00", handle, journal, "j")
        return outcome.collect(), R.job_status(outcome).first()

    outcome, job = run()
    bad = [r for r in outcome if r.status == "Failed"]
    assert [r.key for r in bad] == [files[3]] and bad[0].error
    assert (job.status, job.files, job.failed_files, job.entries) == ("Failed", len(files), 1, rows.count() - damaged)
    open(files[3], "wb").write(whole)
    _, job = run()
    assert (job.status, job.failed_files, job.entries) == ("Completed", 0, rows.count())
    assert handled == [rows.count() - damaged, damaged]
    assert spark.read.parquet(hot).count() == rows.count()


def test_reparse_removes_hours_that_became_empty(spark):
    root, target = new_path(spark, "archive"), new_path(spark, "reparsed")
    rows = entries(spark, "/root/testdata/sf0.001")
    K.write_archive(rows, root)
    K.write_archive(rows, target)
    start, end = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9)
    R.reparse(spark, root, target, lambda df: df.filter("day <> '07' OR hour < '12'"), "tenant-1", start, end)
    left = read_archive(spark, target)
    gone = (F.col("tenant_id") == "tenant-1") & (F.col("day") == "07") & (F.col("hour") >= "12") & (F.col("month") == "01")
    assert left.filter(gone).count() == 0
    assert left.count() == read_archive(spark, root).filter(~gone).count()


def test_days_move_once_whatever_breaks(spark, monkeypatch):
    roots = {name: new_path(spark, name) for name in C.CLASS_AFTER}
    rows = entries(spark, "/root/testdata/sf0.001")
    K.write_archive(rows, roots["Standard"])
    store = C.StorageClasses(spark, roots, new_path(spark, "manifest"))
    want = sorted(r.id for r in rows.select("id").collect())

    def seen():
        return sorted(r.id for r in store.rows().select("id").collect())

    at = dt.datetime(2024, 2, 20)
    for broken in ("_switch", "_clean"):  # broken off after the copy, then after the manifest's change
        calls = []

        def fail(*args, calls=calls, broken=broken):
            calls.append(args)
            if broken == "_switch" or len(calls) > 1:
                raise RuntimeError("stopped")

        with monkeypatch.context() as patch, pytest.raises(RuntimeError):
            patch.setattr(store, broken, fail)
            store.move(at)
        assert seen() == want
    store.move(at)
    assert store.move(at) == {} and seen() == want
    kinds = {r.storage_class: r.n for r in store.rows().groupBy("storage_class").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"Standard", "InfrequentAccess"}
    files = sum(spark.read.schema("id string").option("recursiveFileLookup", "true").parquet(r).count() for r in roots.values() if path_exists(spark, r))
    assert files == len(want)
    assert store.move(dt.datetime(2026, 1, 1))["Deleted"] and seen() == []
