"""Users' SQL sees the given frames and nothing else, wherever it is run."""

from __future__ import annotations

import pytest
from pyspark.sql import Row

from loglake.operators.alerts import evaluate_sql_rules
from loglake.operators.governance import run_sql
from loglake.operators.matviews import define_view
from loglake.operators.user_sql import UnsafeSql, check_sql, run_query
from loglake.plans.fixtures import logs

SF = "/root/testdata/sf0.001"
REFUSED = {
    "backticks": "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home') FROM logs",
    "comment": "SELECT reflect/**/('java.lang.System', 'getProperty', 'user.home') FROM logs",
    "java_method": "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM logs",
    "qualified": "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home') FROM logs",
    "named at run time": "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM logs",
    "table at run time": "SELECT * FROM IDENTIFIER('others')",
    "in a subquery": "SELECT * FROM logs WHERE id IN (SELECT reflect('java.lang.System', 'getProperty', 'user.home'))",
    "in WITH": "WITH x AS (SELECT java_method('java.lang.System', 'exit') AS y) SELECT * FROM x",
    "in a window": "SELECT sum(1) OVER (PARTITION BY try_reflect('java.lang.System', 'getProperty', 'user.home')) FROM logs",
    "in a lateral view": "SELECT * FROM logs LATERAL VIEW explode(array(reflect('java.lang.System', 'getProperty', 'a'))) t AS x",
    "file name": "SELECT input_file_name() FROM logs",
    "file metadata": "SELECT _metadata.file_path FROM logs",
    "user": "SELECT current_user() FROM logs",
    "user without parentheses": "SELECT current_user FROM logs",
    "session": "SELECT session_user, current_database() FROM logs",
    "path": f"SELECT * FROM parquet.`{SF}/nation.parquet`",
    "path in EXISTS": f"SELECT * FROM logs WHERE EXISTS (SELECT 1 FROM parquet.`{SF}/nation.parquet`)",
    "other view": "SELECT * FROM others",
    "table function": "SELECT * FROM range(10)",
    "script": "SELECT TRANSFORM (id) USING 'cat' AS (x) FROM logs",
    "command": "SET x = 1",
    "closing parenthesis": "SELECT 1) UNION ALL (SELECT * FROM others",
    "two statements": "SELECT 1; SELECT 2",
}
ALLOWED = [
    "SELECT count(*) AS n FROM logs",
    "SELECT count(*) AS n FROM (SELECT * FROM logs UNION ALL SELECT * FROM logs) x -- a comment",
    "WITH e AS (SELECT * FROM logs WHERE level = 'Error'), f AS (SELECT * FROM e) SELECT count(*) AS n FROM f;",
    "SELECT max(row_number) AS n FROM (SELECT row_number() OVER (PARTITION BY service ORDER BY timestamp) AS row_number FROM logs)",
    "SELECT count(DISTINCT k) AS n FROM logs LATERAL VIEW explode(map_keys(tags)) t AS k",
    "SELECT count_if(x > 1) AS n FROM (VALUES (1), (2)) AS v(x) CROSS JOIN logs",
    "SELECT sum(CASE WHEN exists(map_values(tags), v -> v = '7') THEN 1 END) AS n FROM logs WHERE timestamp < current_timestamp()",
    "SELECT count(*) AS n FROM logs a JOIN logs b USING (id) WHERE a.id IN (SELECT id FROM logs) GROUP BY ALL HAVING count(*) > 0 ORDER BY 1 LIMIT 5",
]


@pytest.fixture(autouse=True)
def others(spark):
    spark.range(1).createOrReplaceTempView("others")
    yield
    assert [t.name for t in spark.catalog.listTables()] == ["others"]
    spark.catalog.dropTempView("others")


@pytest.mark.parametrize("sql", REFUSED.values(), ids=REFUSED.keys())
def test_refused_everywhere(spark, sql):
    frame = logs(spark, SF)
    with pytest.raises(UnsafeSql):
        run_sql(spark, sql, frame, "tenant-1")
    with pytest.raises(UnsafeSql):
        define_view("v", sql, "bucket").build(frame, "2024-01-31 00:00:00", "7 DAYS")
    rule = Row(rule_id="r", tenant_id="tenant-1", name="n", sql=sql, threshold_operator=">", threshold_value=0.0)
    assert evaluate_sql_rules(spark, frame, [rule]).first().status == "error: UnsafeSql"


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    got = run_sql(spark, sql, logs(spark, SF), "tenant-1").collect()
    assert got and got[0].n is not None


def test_functions_of_users_are_refused(spark):
    spark.udf.register("mine", lambda: 1)
    with pytest.raises(UnsafeSql):
        check_sql(spark, "SELECT mine() FROM logs", {"logs": spark.range(1)})
    spark.sql("DROP TEMPORARY FUNCTION mine")


def test_a_column_may_have_a_special_name(spark):
    frame = spark.range(3).withColumnRenamed("id", "user")
    assert run_query(spark, "SELECT sum(user) AS s FROM t", {"t": frame}).first().s == 3


def test_rules_see_their_own_tenant(spark):
    frame = logs(spark, SF)
    rules = [
        Row(rule_id=t, tenant_id=t, name="n", sql="SELECT count(*) FROM logs", threshold_operator=">", threshold_value=0.0)
        for t in ("tenant-0", "tenant-1", "nobody")
    ]
    got = {r.rule_id: r.actual_value for r in evaluate_sql_rules(spark, frame, rules).collect()}
    assert got == {t: float(frame.filter(frame.tenant_id == t).count()) for t in got} and got["nobody"] == 0


def test_placeholders_are_values(spark):
    frame = logs(spark, SF)
    n = run_query(spark, "SELECT count(*) AS n FROM logs WHERE level = :l", {"logs": frame}, {"l": "x' OR '1' = '1"}).first().n
    assert n == 0
