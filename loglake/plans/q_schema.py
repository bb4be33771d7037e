"""Queries C1–C5, W2, W5, S7, U3: tag schemas and their versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.operators import schema_registry as R
from loglake.plans.fixtures import AS_OF, FIELDS, LOGS, logs, schema_fields, table
from loglake.plans.registry import query
from loglake.session import new_path
from loglake.sources.files import read_merged, union_versions

# One tag per value form; the second element says when the tag is present.
_TAGS = {
    "k": "get_json_object(props, '$.k')",
    "value": "CAST(value AS STRING)",
    "flag": "CASE event_id % 2 WHEN 0 THEN 'true' ELSE ' FALSE ' END",
    "digit_flag": "CAST(event_id % 2 AS STRING)",
    "mixed": "CASE event_id % 100 WHEN 0 THEN 'x' ELSE CAST(event_id AS STRING) END",
    "thousands": "'1,234.5'",
    "day": "CAST(CAST(ts AS DATE) AS STRING)",
    "instant": "concat(CAST(CAST(ts AS DATE) AS STRING), 'T10:11:12.5Z')",
    "year": "'2024'",
    "suffix": "'1d'",
    "blank": "' '",
    "sometimes_blank": "CASE event_id % 3 WHEN 0 THEN '' ELSE '7' END",
    "type": "event_type",
}


def _tagged(spark, sf):
    upper = F.when(F.col("event_id") % 5 == 0, "K").otherwise("k")
    pairs = [x for name, expr in _TAGS.items() for x in (upper if name == "k" else F.lit(name), F.expr(expr))]
    tenant = F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string"))
    return table(spark, sf, "events").select(tenant.alias("tenant_id"), F.create_map(*pairs).alias("tags"))


def _unpivoted_sql() -> str:
    parts = []
    for name, expr in _TAGS.items():
        key = "CASE event_id % 5 WHEN 0 THEN 'K' ELSE 'k' END" if name == "k" else f"'{name}'"
        value = expr.replace("get_json_object", "json_extract_string")
        parts.append(f"SELECT concat('tenant-', CAST(user_id % 4 AS VARCHAR)) AS tenant_id, {key} AS key, {value} AS value FROM events")
    return " UNION ALL ".join(parts)


_INFERRED = f"""WITH pairs AS ({_unpivoted_sql()}), probes AS (SELECT *, trim(value) <> '' AS held, regexp_full_match(lower(trim(value)), 'true|false') AS b,
    regexp_full_match(trim(value), '[+-]?[0-9]+') AND TRY_CAST(trim(value) AS BIGINT) IS NOT NULL AS i,
    regexp_full_match(trim(value), '[+-]?([0-9][0-9,]*(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS d,
    regexp_full_match(trim(value), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\\.[0-9]+)?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?') AS t FROM pairs),
  inferred AS (SELECT {{by}}min(key) AS name, CASE WHEN count(*) FILTER (held) = 0 THEN 'string' WHEN bool_and(b) FILTER (held) THEN 'bool' WHEN bool_and(i) FILTER (held) THEN 'int64'
    WHEN bool_and(d) FILTER (held) THEN 'double' WHEN bool_and(t) FILTER (held) THEN 'timestamp' ELSE 'string' END AS inferred_type,
    true AS is_nullable, count(*) AS observation_count FROM probes GROUP BY {{by}}lower(key))
"""


@query("c1_infer_tag_schema", _INFERRED.replace("{by}", "") + "SELECT * FROM inferred")
def _(spark, sf):
    return R.infer_tag_schema(_tagged(spark, sf))


def _registry(spark, sf):
    return R.as_registry(schema_fields(spark, sf), AS_OF)


@query("w2_latest_version", FIELDS + "SELECT tenant_id, max(version) AS version FROM fields GROUP BY 1")
def _(spark, sf):
    return R.latest_version(_registry(spark, sf))


_TENANT_INFERRED = _INFERRED.replace("{by}", "tenant_id, ").replace("WITH pairs", ", pairs", 1)


@query(
    "c2_register",
    FIELDS + _TENANT_INFERRED + """SELECT tenant_id, version, name, inferred_type, is_nullable, is_deprecated FROM fields
    UNION ALL SELECT tenant_id, coalesce((SELECT max(version) FROM fields f WHERE f.tenant_id = i.tenant_id AND f.tenant_id <> 'x'), 0) + 1, name, inferred_type, true, false FROM inferred i""",
)
def _(spark, sf):
    inferred = R.infer_tag_schema(_tagged(spark, sf), ("tenant_id",))
    return R.field_rows(R.register(_registry(spark, sf), inferred, AS_OF))


@query(
    "c3_conforms",
    LOGS + """, required AS (SELECT tenant_id, CASE tenant_id WHEN 'tenant-0' THEN ['k'] WHEN 'tenant-1' THEN ['k', 'http_status'] WHEN 'tenant-2' THEN ['nothing'] END AS names FROM logs GROUP BY 1)
    SELECT l.id, CASE l.tenant_id WHEN 'tenant-0' THEN l.tag_k IS NOT NULL WHEN 'tenant-1' THEN l.tag_http_status IS NOT NULL WHEN 'tenant-2' THEN false ELSE true END AS conforms
    FROM logs l""",
)
def _(spark, sf):
    rows = logs(spark, sf)
    # Version 1 asks for nothing; version 2 asks for different tags per tenant; tenant-3 has no schema.
    tags = F.when(F.col("tenant_id") == "tenant-0", F.array(F.lit("k"))).when(
        F.col("tenant_id") == "tenant-1", F.array(F.lit("k"), F.lit("http_status"))
    ).when(F.col("tenant_id") == "tenant-2", F.array(F.lit("nothing")))
    tenants = rows.select("tenant_id").distinct().filter("tenant_id <> 'tenant-3'")
    fields = tenants.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "tenant_id", "version", F.explode(F.array_union(tags, F.array(F.lit("optional")))).alias("name")
    ).withColumns(
        {
            "inferred_type": F.lit("string"),
            "is_nullable": (F.col("version") == 1) | (F.col("name") == "optional"),
            "is_deprecated": F.lit(False),
        }
    )
    return R.conforms(rows, R.as_registry(fields, AS_OF)).select("id", "conforms")


_V = "SELECT * FROM fields WHERE version = "


@query(
    "c4_check_evolution",
    FIELDS + f""", o AS ({_V} 2), n AS ({_V} 3),
    dep AS (SELECT tenant_id, name, count(*) FILTER (is_deprecated AND version <= 2) AS d FROM fields GROUP BY 1, 2),
    j AS (SELECT coalesce(o.tenant_id, n.tenant_id) AS tenant_id, coalesce(o.name, n.name) AS name, o.inferred_type AS old_type, n.inferred_type AS new_type,
      o.is_nullable AS on_, n.is_nullable AS nn FROM o FULL JOIN n ON o.tenant_id = n.tenant_id AND o.name = n.name)
    SELECT tenant_id, name, old_type, new_type,
      CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' WHEN old_type <> new_type THEN 'type_changed' WHEN on_ AND NOT nn THEN 'made_required' ELSE 'unchanged' END AS change,
      CASE WHEN old_type IS NULL THEN nn WHEN new_type IS NULL THEN on_ OR d >= 2
        WHEN old_type <> new_type THEN new_type = 'string' OR (old_type = 'int32' AND new_type = 'int64') OR (old_type = 'float' AND new_type = 'double')
        WHEN on_ AND NOT nn THEN false ELSE true END AS is_allowed
    FROM j LEFT JOIN dep USING (tenant_id, name)""",
)
def _(spark, sf):
    fields = schema_fields(spark, sf)
    marked = fields.filter("version <= 2").groupBy("tenant_id", "name").agg(F.count_if("is_deprecated").alias("deprecated_versions"))
    old = fields.filter("version = 2").join(marked, ["tenant_id", "name"], "left")
    return R.check_evolution(old, fields.filter("version = 3"))


_RENAMED_FIELDS = """SELECT tenant_id, version, CASE WHEN version >= 3 AND name LIKE 'view#_%' ESCAPE '#' THEN concat('seen_', substr(name, 6)) ELSE name END AS name,
  inferred_type, is_nullable, is_deprecated, CASE WHEN version >= 3 AND name LIKE 'view#_%' ESCAPE '#' THEN {alias} ELSE {none} END AS aliases FROM {fields}"""


@query(
    "c4_check_versions",
    FIELDS + ", f AS (" + _RENAMED_FIELDS.format(alias="[name]", none="[]", fields="fields") + """),
    follows AS (SELECT * FROM (SELECT tenant_id, version, lead(version) OVER (PARTITION BY tenant_id ORDER BY version) AS next FROM (SELECT DISTINCT tenant_id, version FROM f)) WHERE next IS NOT NULL),
    b AS (SELECT f.tenant_id, next AS version, name, inferred_type, is_nullable,
      (SELECT count(*) FROM f g WHERE g.tenant_id = f.tenant_id AND g.version <= f.version AND g.is_deprecated AND (g.name = f.name OR list_contains(g.aliases, f.name))) AS d
      FROM f JOIN follows USING (tenant_id, version)),
    n AS (SELECT f.*, (SELECT min(b.name) FROM b WHERE b.tenant_id = f.tenant_id AND b.version = f.version AND list_contains(f.aliases, b.name)
        AND NOT EXISTS (SELECT 1 FROM f g WHERE g.tenant_id = f.tenant_id AND g.version = f.version AND g.name = b.name)
        AND NOT EXISTS (SELECT 1 FROM b c WHERE c.tenant_id = f.tenant_id AND c.version = f.version AND c.name = f.name)) AS old_name
      FROM f JOIN (SELECT tenant_id, next AS version FROM follows) USING (tenant_id, version)),
    j AS (SELECT coalesce(n.tenant_id, b.tenant_id) AS tenant_id, coalesce(n.version, b.version) AS version, coalesce(n.name, b.name) AS name, n.old_name,
      b.inferred_type AS old_type, n.inferred_type AS new_type, b.is_nullable AS bn, n.is_nullable AS nn, d
      FROM b FULL JOIN n ON b.tenant_id = n.tenant_id AND b.version = n.version AND b.name = coalesce(n.old_name, n.name)),
    c AS (SELECT *, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' WHEN old_type <> new_type THEN 'type_changed' WHEN bn AND NOT nn THEN 'made_required' ELSE 'unchanged' END AS plain FROM j)
    SELECT tenant_id, version, name, old_name, old_type, new_type, CASE WHEN old_name IS NOT NULL AND plain <> 'made_required' THEN 'renamed' ELSE plain END AS change,
      CASE plain WHEN 'added' THEN nn WHEN 'removed' THEN bn OR coalesce(d, 0) >= 2 WHEN 'type_changed' THEN new_type = 'string' OR (old_type = 'int32' AND new_type = 'int64') OR (old_type = 'float' AND new_type = 'double')
        WHEN 'made_required' THEN false ELSE true END AS is_allowed FROM c""",
)
def _(spark, sf):
    """All versions of all tenants; from the third on a family of fields has a new name."""
    none = "CAST(array() AS ARRAY<STRING>)"
    fields = spark.sql(_RENAMED_FIELDS.format(alias="array(name)", none=none, fields="{fields}"), fields=schema_fields(spark, sf))
    return R.check_versions(fields)


_CHANGES = FIELDS + """, versions AS (SELECT DISTINCT tenant_id, version FROM fields WHERE version > 1),
  p AS (SELECT tenant_id, version + 1 AS version, name, inferred_type, is_deprecated FROM fields),
  j AS (SELECT coalesce(c.tenant_id, p.tenant_id) AS tenant_id, coalesce(c.version, p.version) AS version, coalesce(c.name, p.name) AS name, p.inferred_type AS old_type,
    c.inferred_type AS new_type, c.is_deprecated AS cd, p.is_deprecated AS pd FROM fields c FULL JOIN p ON c.tenant_id = p.tenant_id AND c.version = p.version AND c.name = p.name),
  changes AS (SELECT tenant_id, version, name, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' WHEN cd AND NOT pd THEN 'deprecated'
    WHEN old_type <> new_type THEN 'type_changed' END AS change, old_type, new_type FROM j JOIN versions USING (tenant_id, version))
"""


@query("w5_schema_changes", _CHANGES + "SELECT * FROM changes WHERE change IS NOT NULL")
def _(spark, sf):
    return R.schema_changes(R.field_rows(_registry(spark, sf)))


@query(
    "c5_schema_history",
    _CHANGES + """, sizes AS (SELECT tenant_id, version, count(*) AS field_count FROM fields GROUP BY 1, 2),
    kinds AS (SELECT tenant_id, version, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
      count(*) FILTER (change = 'deprecated') AS deprecated, count(*) FILTER (change = 'type_changed') AS type_changed FROM changes GROUP BY 1, 2)
    SELECT tenant_id, version, field_count, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(deprecated, 0) AS deprecated, coalesce(type_changed, 0) AS type_changed
    FROM sizes LEFT JOIN kinds USING (tenant_id, version)""",
)
def _(spark, sf):
    return R.schema_history(R.field_rows(_registry(spark, sf)))


_MERGED = LOGS + """SELECT id, tenant_id, message, NULL AS trace_id, NULL AS duration_ms FROM logs WHERE timestamp < TIMESTAMP '2024-01-15'
  UNION ALL SELECT id, tenant_id, message, trace_id, duration_ms FROM logs WHERE timestamp >= TIMESTAMP '2024-01-15'"""


def _two_versions(spark, sf):
    rows = logs(spark, sf)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old = rows.filter(F.col("timestamp") < cut).select("id", "tenant_id", "message")
    new = rows.filter(F.col("timestamp") >= cut).select("id", "tenant_id", "message", "trace_id", "duration_ms")
    return old, new


@query("s7_read_merged", _MERGED)
def _(spark, sf):
    paths = [new_path(spark, "merged-v1"), new_path(spark, "merged-v2")]
    for path, rows in zip(paths, _two_versions(spark, sf)):
        rows.write.parquet(path)
    return read_merged(spark, *paths)


@query("u3_union_versions", _MERGED)
def _(spark, sf):
    return union_versions(*_two_versions(spark, sf))
