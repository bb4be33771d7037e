"""Cases behind the registered queries: isolation, escaped tenants, rule keys, caps."""

from __future__ import annotations

import datetime as dt

import pytest

from loglake.operators import alerts as L
from loglake.operators import dedup as D
from loglake.operators.filters import errors_only, min_severity, name_in
from loglake.operators.governance import UnsafeSql, run_saved, run_sql
from loglake.operators.ingest import to_entries
from loglake.operators.search import search_predicate
from loglake.plans.fixtures import dtos, entries, logs
from loglake.session import new_path
from loglake.sinks import tables as K
from loglake.sources.files import read_archive

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
        "SELECT * FROM others",
        "SELECT (SELECT count(*) FROM others) AS n FROM logs",
        "WITH o AS (SELECT * FROM others) SELECT * FROM o",
        "SET spark.sql.ansi.enabled=false",
        "ADD JAR 'x.jar'",
        "MERGE INTO logs USING logs AS b ON logs.id = b.id WHEN MATCHED THEN DELETE",
        "SELECT reflect('java.lang.System', 'getenv') FROM logs",
        "SELECT 1; SELECT 2",
        "SHOW TABLES",
        "DESCRIBE logs",
    ],
)
def test_user_sql_reaches_only_the_given_frames(spark, sql):
    spark.range(1).createOrReplaceTempView("others")
    before = spark.conf.get("spark.sql.ansi.enabled")
    with pytest.raises(UnsafeSql):
        run_sql(spark, sql, logs(spark, SF), "tenant-1")
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_user_sql_leaves_no_view_and_accepts_with(spark):
    sql = "WITH e AS (SELECT * FROM logs) SELECT count(*) AS n FROM e JOIN lookup ON lookup.id = 0"
    result = run_sql(spark, sql, logs(spark, SF), "tenant-1", lookup=spark.range(1))
    assert result.first().n == logs(spark, SF).filter("tenant_id = 'tenant-1'").count()
    assert not {"logs", "lookup"} & {t.name for t in spark.catalog.listTables()}
    with pytest.raises(UnsafeSql):
        run_sql(spark, "SELECT * FROM lookup", logs(spark, SF), "tenant-2")


def test_saved_query_belongs_to_its_tenant(spark):
    saved = spark.createDataFrame([("tenant-1", "q", "SELECT 1 AS one")], "tenant_id string, query_id string, sql string")
    assert run_saved(spark, saved, "tenant-1", "q", logs(spark, SF)).first().one == 1
    with pytest.raises(LookupError):
        run_saved(spark, saved, "tenant-2", "q", logs(spark, SF))


def _odd_tenant(spark, n=50):
    from pyspark.sql import functions as F

    return entries(spark, SF).limit(n).withColumn("tenant_id", F.lit("acme:eu"))


def test_escaped_tenant_is_read_and_deleted(spark):
    root = new_path(spark, "archive")
    K.write_archive(_odd_tenant(spark).unionByName(entries(spark, SF)), root)
    assert read_archive(spark, root, "acme:eu").count() == 50
    other = read_archive(spark, root, "tenant-1").count()
    K.delete_tenant(spark, root, "acme:eu")
    assert read_archive(spark, root, "acme:eu").count() == 0 and read_archive(spark, root, "tenant-1").count() == other
    with pytest.raises(LookupError):
        K.delete_tenant(spark, root, "acme:eu")


def test_escaped_tenant_keeps_one_version_when_an_id_moves(spark):
    from pyspark.sql import functions as F

    root = new_path(spark, "hot")
    batch = _odd_tenant(spark).withColumn("timestamp", F.timestamp_millis("timestamp_unix_ms"))
    K.upsert_hot(batch, root)
    later = F.expr("INTERVAL 40 DAYS")
    moved = batch.withColumns({"timestamp": F.col("timestamp") + later, "ingested_at": F.col("ingested_at") + later})
    for _ in range(2):
        K.upsert_hot(moved, root)
        stored = spark.read.parquet(root)
        assert stored.count() == batch.select("id").distinct().count()
        assert stored.agg(F.min("timestamp")).first()[0] >= moved.agg(F.min("timestamp")).first()[0]


def test_upsert_leaves_other_tenants_alone(spark):
    root = new_path(spark, "hot")
    K.upsert_hot(entries(spark, SF), root)
    mine = entries(spark, SF).filter("tenant_id = 'tenant-1'").limit(5)
    before = [f for f in spark.read.parquet(root).inputFiles() if "tenant_id=tenant-1/" not in f]
    K.upsert_hot(mine, root)
    assert set(before) <= set(spark.read.parquet(root).inputFiles())


def test_without_tenant_keeps_rows_without_one(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "tenant_id string")
    assert {r.tenant_id for r in K.without_tenant(df, "a").collect()} == {"b", None}


RULE = "rule_id string, tenant_id string, name string, measure string, log_type string, level string, window_minutes int, threshold_operator string, threshold_value double, is_enabled boolean"
LOG = "tenant_id string, log_type string, level string, timestamp timestamp, duration_ms double"


def test_rules_of_a_week_and_of_equal_id(spark):
    now = dt.datetime(2024, 1, 30)
    rows = [("t", "Error", "Error", now - dt.timedelta(days=d), 1.0) for d in (1, 3, 6, 8)]
    rules = [("r", t, "n", "count", None, None, 7 * 1440, ">=", 3.0, True) for t in ("t", "u")]
    got = L.evaluate_rules(spark.createDataFrame(rows, LOG), spark.createDataFrame(rules, RULE), now)
    assert {r.tenant_id: (r.actual_value, r.is_breached) for r in got.collect()} == {"t": (3.0, True), "u": (0.0, False)}


def test_backtest_fires_on_silence(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("t", "Error", "Error", start + dt.timedelta(hours=5), 1.0)], LOG)
    rules = spark.createDataFrame(
        [("r", "t", "n", "count", None, None, 60, "<", 1.0, True), ("m", "t", "n", "max", None, None, 60, "<", 9.0, True)], RULE
    )
    fired = L.backtest_rules(rows, rules, start, start + dt.timedelta(days=1)).collect()
    hours = sorted(r.window_start.hour for r in fired if r.rule_id == "r")
    assert hours == [h for h in range(24) if h != 5]
    assert [r.window_start.hour for r in fired if r.rule_id == "m"] == [5]


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("error NOT fatal", {1}), ("error slow NOT fatal", {1, 3}), ("NOT fatal", {1, 3, 4}), ("(error slow) AND NOT fatal", {1, 3}),
        ("error AND NOT fatal", {1}), ("(error NOT fatal) slow", {1, 3}), ("slow NOT (error OR disk)", {3}), ("error OR NOT fatal", {1, 2, 3, 4}),
    ],
)
def test_bare_not_excludes(spark, query, ids):
    rows = [(1, "an error"), (2, "fatal error"), (3, "slow"), (4, "fine")]
    df = spark.createDataFrame(rows, "id int, message string")
    assert {r.id for r in df.filter(search_predicate(query, ("message",), tags=None)).collect()} == ids


def test_level_and_type_predicates_reach_the_scan(spark):
    path = new_path(spark, "levels")
    logs(spark, SF).select("level", "log_type", "message").write.parquet(path)
    df = spark.read.parquet(path)
    for rows in (errors_only(df), name_in(df, "log_type", "ERROR"), min_severity(df, "warning")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :]
        assert "EqualTo" in pushed or "In(" in pushed


def test_generated_ids_cover_all_client_fields(spark):
    base = dtos(spark, SF).limit(1)
    from pyspark.sql import functions as F

    variants = [base] + [
        base.withColumn(c, F.lit(v))
        for c, v in (("level", "Fatal"), ("log_type", "Audit"), ("environment", "e2"), ("category", "c2"), ("stack_trace", "s2"))
    ]
    ids = {to_entries(v.drop("id"), "t", "Push", "2024-01-01").first().id for v in variants}
    assert len(ids) == len(variants)
    swapped = [base.withColumn("tags", F.expr(f"map({m})")) for m in ("'a', '1', 'b', '2'", "'b', '2', 'a', '1'")]
    assert len({to_entries(v.drop("id"), "t", "Push", "2024-01-01").first().id for v in swapped}) == 1


def test_equal_times_give_one_new_row(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("t", "x", at, i) for i in range(5)] + [("t", "x", at + dt.timedelta(hours=30), 9)]
    df = spark.createDataFrame(rows, "tenant_id string, id string, ingested_at timestamp, n int")
    assert sum(r.is_new for r in D.mark_first_seen(df).collect()) == 2
