from __future__ import annotations

import datetime as dt
import gzip
import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from loglake.operators.aggregates import exact_percentile, histogram_quantile
from loglake.operators.joins import densify
from loglake.operators.replay import replay_prefixes
from loglake.plans import all_queries
from loglake.session import new_path
from loglake.sinks.tables import fan_out
from loglake.sources import files as S


T0 = dt.datetime(2024, 1, 1)


def entry(i, **more):
    return {"id": str(i), "source_id": "s", "log_type": "Error", "level": "Error", "environment": "test", "timestamp_unix_ms": 1711372800000 + i,
            "message": "ok", "tenant_id": "source-tenant", **more}


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "2026-03-25-1.ndjson").write_text(json.dumps(entry(1)) + "\n\n{broken\n")
    (d / "2026-03-25-2.ndjson").write_text(json.dumps(entry(2, tags={"a": "b"})) + "\n")
    return d


def test_ndjson_takes_the_jobs_tenant_and_skips_what_it_cannot_read(spark, folder):
    rows = S.read_ndjson(spark, str(folder), "tenant-abc").collect()
    assert sorted((r.id, r.tenant_id) for r in rows) == [("1", "tenant-abc"), ("2", "tenant-abc")]
    _, bad = S.parse_ndjson(spark.read.text(str(folder)))
    assert [r.raw for r in bad.collect()] == ["{broken"]


def test_gzip_is_read(spark, tmp_path):
    with gzip.open(tmp_path / "a.ndjson.gz", "wt") as f:
        f.write(json.dumps(entry(5)))
    assert S.read_ndjson(spark, str(tmp_path), "t").first().id == "5"


def test_pull_resumes_after_the_saved_key(spark, folder):
    rows, state = S.pull_new_files(spark, str(folder), None, "t")
    key = state.first().last_key
    assert rows.count() == 2 and key.endswith("2026-03-25-2.ndjson")
    (folder / "2026-03-26-1.ndjson").write_text(json.dumps(entry(3)))
    rows, state = S.pull_new_files(spark, str(folder), key, "t")
    assert [r.id for r in rows.collect()] == ["3"] and state.first().last_key.endswith("26-1.ndjson")
    again, state = S.pull_new_files(spark, str(folder), state.first().last_key, "t")
    assert again.count() == 0 and state.first().last_key is None


def test_json_array(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps([entry(1), entry(2)]))
    assert {r.tenant_id for r in S.read_json_array(spark, str(tmp_path), "tenant-1").collect()} == {"tenant-1"}


def test_json_pages_are_files_of_one_folder(spark, tmp_path):
    """The registered query's input: a page of at most a hundred entries a file, and no folder for each."""
    times = [T0 + dt.timedelta(minutes=i) for i in range(950)]
    rows = [(i, times[i], i % 7, "view" if i % 2 else "error", float(i), f'{{"k": {i % 9}}}') for i in range(950)]
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "events.parquet"))
    read = all_queries()[0]["s3_read_json_array"](spark, str(tmp_path))
    assert sorted(int(r.id) for r in read.collect()) == list(range(950))
    files = [f.removeprefix("file:") for f in read.inputFiles()]
    assert len(files) == 10 and len({os.path.dirname(f) for f in files}) == 1
    assert all(len(json.loads(open(f).read())) <= 100 for f in files)


def test_merged_versions_and_conflicts(spark):
    a, b, c = (new_path(spark, "v") for _ in range(3))
    spark.createDataFrame([(1,)], "id int").write.parquet(a)
    spark.createDataFrame([(2, "x")], "id int, extra string").write.parquet(b)
    spark.createDataFrame([("3",)], "id string").write.parquet(c)
    assert sorted((r.id, r.extra) for r in S.read_merged(spark, a, b).collect()) == [(1, None), (2, "x")]
    with pytest.raises((PySparkException, Py4JJavaError)):
        S.read_merged(spark, a, c).collect()


def test_replay_prefix_of_one_month(spark):
    jobs = spark.createDataFrame([("j", "tenant-1", dt.datetime(2024, 5, 3), dt.datetime(2024, 5, 31)), ("k", "t", dt.datetime(2024, 11, 30), dt.datetime(2025, 1, 1))],
                                 "job_id string, tenant_id string, t_from timestamp, t_to timestamp")
    got = {}
    for r in replay_prefixes(jobs).collect():
        got.setdefault(r.job_id, []).append(r.prefix)
    assert got["j"] == ["logs/tenant-1/2024/05/"]
    assert sorted(got["k"]) == ["logs/t/2024/11/", "logs/t/2024/12/", "logs/t/2025/01/"]


def test_a_failing_sink_does_not_stop_the_others(spark):
    path = new_path(spark, "sink")

    def broken(_):
        raise OSError("down")

    assert fan_out(spark.range(5), {"bad": broken, "good": lambda df: df.write.parquet(path)}).keys() == {"bad"}
    assert spark.read.parquet(path).count() == 5


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.95, 0.999, 1.0])
def test_exact_percentile_with_a_hot_group(spark, q):
    from pyspark.sql import functions as F

    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        (F.pow(F.rand(1), 3) * 1000).alias("v"), F.floor(F.rand(2) * 9).cast("double").alias("w"),
    ).persist()
    for col in ("v", "w"):
        want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile(col, q).alias("p")).collect()}
        got = {r.g: r.percentile for r in exact_percentile(df, ["g"], col, q).collect()}
        assert got == pytest.approx(want)
    df.unpersist()


def test_histogram_quantile_edges(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 7.0), ("b", 99.0), ("c", None)], "k string, v double")
    got = {r.k: r.estimate for r in histogram_quantile(df, "v", 0.5, ["k"], [5.0, 10.0]).collect()}
    assert got == {"a": 5.0, "b": 10.0}


def test_densify_keeps_null_labels_and_fills(spark):
    df = spark.createDataFrame([("x", "a", 1), (None, "b", 2), ("y", None, 3)], "l string, c string, v int")
    got = {(r.l, r.c): r.v for r in densify(df, "l", "c", "v").collect()}
    assert len(got) == 9 and got[("x", "a")] == 1 and got[(None, "b")] == 2 and got[("y", None)] == 3 and got[("x", "b")] == 0


def test_shared_dir_comes_from_the_session(spark):
    from loglake.session import shared_dir

    assert os.path.basename(new_path(spark, "x")).startswith("x-")
    assert new_path(spark, "x").startswith(shared_dir(spark))
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_archive_reads_list_only_what_exists(spark):
    from pyspark.sql import functions as F

    from loglake import schema
    from loglake.operators.ingest import to_entries
    from loglake.sinks.tables import write_archive

    days = [dt.datetime(2024, 1, 31, 23, 59), dt.datetime(2024, 2, 1), dt.datetime(2024, 12, 31, 5), dt.datetime(2025, 1, 1)]
    rows = [(f"t{t}", f"t{t}-{i}", d) for t in (1, 2) for i, d in enumerate(days)]
    dtos = spark.createDataFrame(rows, "tenant string, id string, timestamp timestamp")
    for f in schema.LOG_ENTRY_DTO.fields:
        if f.name not in dtos.columns:
            dtos = dtos.withColumn(f.name, F.lit(None).cast(f.dataType))
    root = new_path(spark, "archive")
    write_archive(to_entries(dtos, F.col("tenant"), "Push", "2025-01-02 00:00:00"), root)

    def ids(*args):
        return {r.id for r in S.read_archive(spark, root, *args).collect()}

    assert ids() == {r[1] for r in rows}
    assert ids("t1") == {f"t1-{i}" for i in range(4)}
    assert ids("t1", dt.datetime(2024, 1, 31, 23, 59), dt.datetime(2025, 1, 1)) == {"t1-0", "t1-1", "t1-2"}
    assert ids("t2", dt.datetime(2024, 12, 1), dt.datetime(2025, 1, 1, 1)) == {"t2-2", "t2-3"}
    assert ids("t9") == set() and ids("t1", dt.datetime(2023, 1, 1), dt.datetime(2023, 3, 1)) == set()
