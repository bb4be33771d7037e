"""Routing, SQL safety, tag inference, charts and search on hand-made rows."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from loglake.operators import charts as H
from loglake.operators import governance as G
from loglake.operators import schema_registry as R
from loglake.operators import search as S
from loglake.operators import tiers as T
from loglake.operators.filters import check_tenant_id

NOW = dt.datetime(2026, 3, 25, 12)
QUERY = "query_id string, tenant_id string, has_full_text boolean, earliest timestamp, latest timestamp"


def days(n):
    return None if n is None else NOW + dt.timedelta(days=n)


ROUTES = [
    ("text", -2, -1, True, "Hot", []),
    ("no range", None, None, False, "Hot", []),
    ("recent", -2, -1, False, "Hot", []),
    ("month", -30, -8, False, "Warm", []),
    ("old", -120, -100, False, "Cold", []),
    ("hot and warm", -30, -2, False, "CrossTier", [("Hot", -7, -2), ("Warm", -30, -7)]),
    ("warm and cold", -120, -10, False, "CrossTier", [("Cold", -120, -90), ("Warm", -90, -10)]),
    ("everything", -120, 0, False, "CrossTier", [("Cold", -120, -90), ("Hot", -7, 0), ("Warm", -90, -7)]),
    ("into the future", -2, 1, False, "CrossTier", [("Hot", -2, 1)]),
]


def test_routes_and_sub_ranges(spark):
    rows = [(n, "t", ft, days(a), days(b)) for n, a, b, ft, _, _ in ROUTES]
    settings = spark.createDataFrame([("t", 7, 90)], "tenant_id string, hot_retention_days int, warm_retention_days int")
    routed = T.route_queries(spark.createDataFrame(rows, QUERY), settings, str(NOW))
    assert {r.query_id: r.tier for r in routed.collect()} == {n: tier for n, _, _, _, tier, _ in ROUTES}
    parts = {}
    for r in T.split_ranges(routed, str(NOW)).collect():
        parts.setdefault(r.query_id, []).append((r.sub_tier, r.range_from, r.range_to))
    want = {n: [(t, days(a), days(b)) for t, a, b in p] for n, _, _, _, _, p in ROUTES if p}
    assert {k: sorted(v) for k, v in parts.items()} == want


def test_sub_ranges_cut_the_time_axis_without_gaps(spark):
    rows = [(f"{a}-{b}", "t", False, days(a), days(b)) for a in range(-130, 0, 9) for b in range(a + 1, 3, 7)]
    settings = spark.createDataFrame([("t", 7, 90)], "tenant_id string, hot_retention_days int, warm_retention_days int")
    parts = T.split_ranges(T.route_queries(spark.createDataFrame(rows, QUERY), settings, str(NOW)), str(NOW))
    seen = {}
    for r in parts.collect():
        seen.setdefault(r.query_id, []).append((r.range_from, r.range_to))
    for qid, _, _, lo, hi in rows:
        if qid in seen:
            cut = sorted(seen[qid])
            assert cut[0][0] == lo and cut[-1][1] == hi and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))


@pytest.mark.parametrize("verb", G.FORBIDDEN)
def test_forbidden_verbs(spark, verb):
    rows = [(f"{verb} x",), (f"select 1; {verb.lower()} x",), (f"SELECT ({verb}\tx)",), ("SELECT 1 FROM logs LIMIT 1",)]
    df = spark.createDataFrame(rows, "sql string")
    assert [bool(r.errors) for r in G.sql_safety(df).collect()] == [True, True, False, False]
    assert [bool(r.errors) for r in G.sql_safety(df, strict=True).collect()] == [True, True, True, False]


def test_run_sql_rejects_writes_and_scopes_the_tenant(spark):
    logs = spark.createDataFrame(
        [("a", "t1", "s", dt.datetime(2024, 1, 1)), ("b", "t2", "s", dt.datetime(2024, 1, 1))],
        "id string, tenant_id string, source_id string, timestamp timestamp",
    ).withColumns({"log_type": F.lit("Error"), "level": F.lit("Error"), "trace_id": F.lit("x"), "tags": F.expr("map('drop table', 'x')"),
                   "metric": F.lit(None).cast("struct<value:double>")})
    with pytest.raises(G.UnsafeSql):
        G.run_sql(spark, "SELECT 1; DROP TABLE users", logs, "t1")
    rows = G.run_sql(spark, "SELECT id, 'drop it' AS note FROM logs WHERE service = :s", logs, "t1", {"s": "s"}).collect()
    assert [(r.id, r.note) for r in rows] == [("a", "drop it")]


def test_sql_time_range(spark):
    sql = "SELECT '2020-01-01' FROM logs WHERE ts >= '2026-03-01' AND ts < '2026-03-02T10:00:00+02:00' limit 5"
    df = spark.createDataFrame([(sql,), ("SELECT 1 WHERE ts > NOW() - INTERVAL '1' DAY",), ("x '2026-99-01'",)], "sql string")
    a, b, c = G.sql_time_range(df).collect()
    assert (a.earliest, a.latest, a.has_limit) == (dt.datetime(2026, 3, 1), dt.datetime(2026, 3, 2, 8), True)
    assert not b.has_time_filter and c.earliest is None


@pytest.mark.parametrize("tenant, problem", [("tenant-1", None), ("", "empty"), (None, "empty"), (" ", "empty"), ("a'b", "unsafe"), ("a--b", "unsafe"), ("a;b", "unsafe"), ('a"b', "unsafe"), ("a\\b", "unsafe")])
def test_tenant_ids(spark, tenant, problem):
    assert spark.createDataFrame([(tenant,)], "t string").select(check_tenant_id(F.col("t")).alias("p")).first().p == problem


TAG_CASES = [
    ([{"region": "us-east"}], {"region": "string"}),
    ([{"latency": "123"}, {"latency": "456"}], {"latency": "int64"}),
    ([], {}),
    ([None, {}], {}),
    ([{"duration": "1"}, {"duration": "1.5"}], {"duration": "double"}),
    ([{"region": "us-east", "role": "api"}], {"region": "string", "role": "string"}),
    ([{"b": "true"}, {"b": "FALSE"}], {"b": "bool"}),
    ([{"b": "1"}, {"b": "0"}], {"b": "int64"}),
    ([{"b": "true"}, {"b": "1"}], {"b": "string"}),
    ([{"t": "2026-03-25T10:00:00Z"}, {"t": "2026-03-25"}], {"t": "timestamp"}),
    ([{"x": " "}, {"x": ""}], {"x": "string"}),
    ([{"x": " "}, {"x": "\t7 "}], {"x": "int64"}),
    ([{"Key": "1"}, {"key": "2"}], {"Key": "int64"}),
    ([{"n": "99999999999999999999"}], {"n": "double"}),
    ([{"n": "NaN"}, {"n": "-Infinity"}, {"n": "1"}], {"n": "double"}),
]


@pytest.mark.parametrize("tags, want", TAG_CASES)
def test_tag_inference(spark, tags, want):
    df = spark.createDataFrame([(t,) for t in tags], "tags map<string,string>")
    rows = R.infer_tag_schema(df).collect()
    assert {r.name: r.inferred_type for r in rows} == want
    assert all(r.is_nullable for r in rows)


def test_registered_versions_count_up(spark):
    empty = spark.createDataFrame([], "tenant_id string, version int, fields array<struct<name:string,inferred_type:string,is_nullable:boolean,is_deprecated:boolean>>, registered_at timestamp")
    inferred = spark.createDataFrame([("t", "k", "int64", True, 3)], "tenant_id string, name string, inferred_type string, is_nullable boolean, observation_count long")
    one = R.register(empty, inferred, NOW)
    two = R.register(one, inferred, NOW)
    assert sorted(r.version for r in two.collect()) == [1, 2]


EVOLUTION = [
    ("int32", "int64", True), ("float", "double", True), ("bool", "string", True), ("int64", "int32", False),
    ("string", "int64", False), ("int32", "timestamp", False), ("int64", "int64", True),
]


def test_evolution_rules(spark):
    fields = "tenant_id string, name string, inferred_type string, is_nullable boolean, deprecated_versions int"
    old = [("t", f"c{i}", a, True, 0) for i, (a, _, _) in enumerate(EVOLUTION)] + [("t", "gone", "string", False, 1), ("t", "retired", "string", False, 2)]
    new = [("t", f"c{i}", b, True, 0) for i, (_, b, _) in enumerate(EVOLUTION)] + [("t", "extra", "string", True, 0), ("t", "must", "string", False, 0)]
    got = {r.name: r.is_allowed for r in R.check_evolution(spark.createDataFrame(old, fields), spark.createDataFrame(new, fields)).collect()}
    want = {f"c{i}": ok for i, (_, _, ok) in enumerate(EVOLUTION)} | {"gone": False, "retired": True, "extra": True, "must": False}
    assert got == want


CHARTS = [
    ([("timestamp", False, True, False), ("value", True, False, False)], 10, ["LineChart"]),
    ([("level", False, False, True), ("count", True, False, False)], 10, ["BarChart"]),
    ([("duration_ms", True, False, False), ("request_bytes", True, False, False)], 10, ["Scatter"]),
    ([("latency_ms", True, False, False)], 1, ["Gauge"]),
    ([("timestamp", False, True, False), ("service", False, False, True), ("count", True, False, False)], 10, ["AreaChart", "StackedAreaChart"]),
    ([("hour_of_day", True, False, False), ("day_of_week", True, False, False), ("error_count", True, False, False)], 10, ["HeatMap"]),
]


def test_chart_suggestions(spark):
    rows = [(i, n, p, *c) for i, (cols, n, _) in enumerate(CHARTS) for p, c in enumerate(cols)]
    df = spark.createDataFrame(rows, "result_id int, row_count int, position int, name string, is_numeric boolean, is_timestamp boolean, is_categorical boolean")
    got = {}
    for r in H.suggest_charts(df).orderBy("result_id", "rank").collect():
        got.setdefault(r.result_id, []).append(r.chart)
    assert got == {i: want for i, (_, _, want) in enumerate(CHARTS)}


def test_described_result_gets_a_chart(spark):
    df = spark.createDataFrame([(NOW, "a", 1)], "minute_bucket timestamp, service string, error_count long")
    assert H.suggest_charts(H.describe_columns(df, "r", 1)).orderBy("rank").first().chart == "AreaChart"


TEXTS = [
    "Connection refused by mysql", "connection was refused", "CONNECTION REFUSED: postgres", "disk error", "errors happen", "Timeout after 30s",
    "user_id 1234", "the database", "élan vital", "lan", "", None, "refused connection mysql", "Out of memory", "a-b c", "connection  refused\nmysql",
]


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def has(text, *phrase):
    w = words_of(text)
    return any(w[i : i + len(phrase)] == list(phrase) for i in range(len(w)))


SEARCHES = {
    "error": lambda t: has(t, "error"),
    "ERROR database timeout": lambda t: has(t, "error") or has(t, "database") or has(t, "timeout"),
    '"connection refused" AND (mysql OR postgres)': lambda t: has(t, "connection", "refused") and (has(t, "mysql") or has(t, "postgres")),
    "NOT connection": lambda t: not has(t, "connection"),
    "refused AND NOT mysql OR disk": lambda t: has(t, "refused") and not has(t, "mysql") or has(t, "disk"),
    "err*": lambda t: any(w.startswith("err") for w in words_of(t)),
    "*base": lambda t: any(w.endswith("base") for w in words_of(t)),
    "l?n": lambda t: has(t, "lan"),
    "lan": lambda t: has(t, "lan"),
    "a-b": lambda t: has(t, "a", "b"),
    "message:memory": lambda t: has(t, "memory"),
    '""': lambda t: True,
    "": lambda t: True,
}


@pytest.mark.parametrize("query", list(SEARCHES))
def test_search_against_plain_python(spark, query):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, message string")
    got = {r.id for r in df.filter(S.search_predicate(query, ("message",), tags=None)).collect()}
    assert got == {i for i, t in enumerate(TEXTS) if SEARCHES[query](t)}


def test_search_looks_at_category_and_tags_but_not_across_them(spark):
    rows = [(1, "x", "disk", {"a": "full"}), (2, "y", None, {"a": "disk full"}), (3, "disk", "full", None), (4, "z", None, {"user": "7abc"})]
    df = spark.createDataFrame(rows, "id int, message string, category string, tags map<string,string>")
    ids = lambda q: {r.id for r in df.filter(S.search_predicate(q)).collect()}
    assert ids("disk") == {1, 2, 3} and ids('"disk full"') == {2} and ids("user:7*") == {4} and ids("tags.a:full") == {1, 2}
