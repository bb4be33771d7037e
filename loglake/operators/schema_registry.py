"""Per-tenant tag schemas: inference, versions, conformance and evolution.

A registry is a frame (tenant_id, version, fields, registered_at) with versions 1, 2, 3 … per tenant.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.functions.columns import parses_bool, parses_double, parses_int64, parses_timestamp, stripped

FIELD_COLUMNS = ["name", "inferred_type", "is_nullable", "is_deprecated"]

# Type changes that lose nothing. Anything may also become a string.
WIDENINGS = [("int32", "int64"), ("float", "double")]

_BLANK, _BOOL, _INT64, _DOUBLE, _TIMESTAMP, _TEXT = (1 << i for i in range(6))


def infer_tag_schema(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Type of every tag key: the first of bool, int64, double, timestamp that all its values parse as.

    Keys that differ only in case are one field; blank values are counted but do not decide the type.
    The forms seen are a bit mask combined on the map side, so a tag present on every row is no hot key.
    """
    v = F.col("value")
    # One bit per value form. A value is tested until its first form is found, the forms being disjoint.
    form = (
        F.when(v == "", _BLANK)
        .when(parses_int64(v), _INT64)
        .when(parses_double(v), _DOUBLE)
        .when(parses_bool(v), _BOOL)
        .when(parses_timestamp(v), _TIMESTAMP)
        .otherwise(_TEXT)
    )
    pairs = df.select(*by, F.explode("tags").alias("key", "value")).withColumn("value", F.coalesce(stripped(F.col("value")), F.lit("")))
    # By exact key first: with numbers only in the buffer this is a hash aggregation, and what is left
    # for choosing the spelling is one row per key.
    exact = pairs.groupBy(*by, "key").agg(F.bit_or(form).alias("forms"), F.count(F.lit(1)).alias("n"))
    seen = exact.groupBy(*by, F.lower("key").alias("field")).agg(
        F.min("key").alias("name"), F.bit_or("forms").alias("forms"), F.sum("n").alias("observation_count")
    )
    held = F.col("forms").bitwiseAND(F.lit(~_BLANK))
    kind = (
        F.when(held == _BOOL, "bool")
        .when(held == _INT64, "int64")
        .when(held.isin(_DOUBLE, _DOUBLE | _INT64), "double")
        .when(held == _TIMESTAMP, "timestamp")
        .otherwise("string")
    )
    return seen.select(*by, "name", kind.alias("inferred_type"), F.lit(True).alias("is_nullable"), "observation_count")


def field_rows(registry: DataFrame) -> DataFrame:
    """One row per tenant, version and field."""
    return registry.select("tenant_id", "version", F.inline("fields"))


def as_registry(fields: DataFrame, registered_at: dt.datetime | str) -> DataFrame:
    """The reverse: field rows (tenant_id, version, …) to one row per version."""
    entry = F.struct(*FIELD_COLUMNS)
    return (
        fields.groupBy("tenant_id", "version")
        .agg(F.sort_array(F.collect_list(entry)).alias("fields"))
        .withColumn("registered_at", F.lit(str(registered_at)).cast("timestamp"))
    )


def latest_version(registry: DataFrame) -> DataFrame:
    return registry.groupBy("tenant_id").agg(F.max("version").alias("version"))


def current_schema(registry: DataFrame) -> DataFrame:
    return registry.groupBy("tenant_id").agg(F.max_by(F.struct("version", "fields"), "version").alias("r")).select(
        "tenant_id", "r.version", "r.fields"
    )


def register(registry: DataFrame, inferred: DataFrame, registered_at: dt.datetime | str) -> DataFrame:
    """The registry with one more version per tenant of `inferred` (tenant_id, name, inferred_type, …)."""
    if "is_deprecated" not in inferred.columns:
        inferred = inferred.withColumn("is_deprecated", F.lit(False))
    head = inferred.join(latest_version(registry).withColumnRenamed("version", "prev"), "tenant_id", "left")
    fresh = head.withColumn("version", F.coalesce("prev", F.lit(0)) + 1).drop("prev")
    return registry.unionByName(as_registry(fresh, registered_at))


def conforms(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Add `conforms`: all required fields of the tenant's current schema are present as tags."""
    required = current_schema(registry).select(
        "tenant_id",
        F.transform(F.filter("fields", lambda f: ~f["is_nullable"]), lambda f: f["name"]).alias("__required"),
    )
    keys = F.coalesce(F.map_keys("tags"), F.array().cast("array<string>"))
    missing = F.array_except(F.coalesce("__required", F.array().cast("array<string>")), keys)
    return df.join(required, "tenant_id", "left").withColumn("conforms", F.size(missing) == 0).drop("__required")


def _widens(old: Column, new: Column) -> Column:
    ok = new == "string"
    for a, b in WIDENINGS:
        ok = ok | ((old == a) & (new == b))
    return ok


def check_evolution(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Field-by-field verdict on replacing the `old` field rows by `new`.

    `deprecated_versions` in `old` is the number of versions in which a field was marked deprecated.
    """
    on = [*keys, "name"]
    o = old.select(
        *on,
        F.col("inferred_type").alias("old_type"),
        F.col("is_nullable").alias("old_nullable"),
        F.col("deprecated_versions"),
    )
    n = new.select(*on, F.col("inferred_type").alias("new_type"), F.col("is_nullable").alias("new_nullable"))
    both = o.join(n, on, "full")
    added, removed = F.col("old_type").isNull(), F.col("new_type").isNull()
    change = (
        F.when(added, "added")
        .when(removed, "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
        .when(F.col("old_nullable") & ~F.col("new_nullable"), "made_required")
        .otherwise("unchanged")
    )
    allowed = (
        F.when(F.col("change") == "added", F.col("new_nullable"))
        .when(F.col("change") == "removed", F.col("old_nullable") | (F.col("deprecated_versions") >= 2))
        .when(F.col("change") == "type_changed", _widens(F.col("old_type"), F.col("new_type")))
        .when(F.col("change") == "made_required", F.lit(False))
        .otherwise(F.lit(True))
    )
    return both.withColumn("change", change).withColumn("is_allowed", allowed).select(
        *on, "old_type", "new_type", "change", "is_allowed"
    )


def _renamed(fields: DataFrame, before: DataFrame) -> DataFrame:
    """tenant_id, version, name, old_name of the fields that carry on one of the version before under a new name.

    A field names its former names in `aliases`. It is a rename if the version before has one of them, this one no
    longer has it, and the new name is new; of several the smallest counts.
    """
    here, key = fields.select("tenant_id", "version", "name"), ["tenant_id", "version", "name"]
    new = fields.join(before.select(*key), key, "left_anti").select(*key, F.explode("aliases").alias("old_name"))
    had = before.select("tenant_id", "version", F.col("name").alias("old_name"))
    gone = had.join(here.withColumnRenamed("name", "old_name"), ["tenant_id", "version", "old_name"], "left_anti")
    return new.join(gone, ["tenant_id", "version", "old_name"]).groupBy(*key).agg(F.min("old_name").alias("old_name"))


def check_versions(fields: DataFrame) -> DataFrame:
    """Verdict on every field of every version against the version before it, by tenant.

    `fields` has one row per tenant, version and field, as `check_evolution` takes them, with `is_deprecated` and,
    optionally, `aliases`. A field that goes on under a new name is `renamed`, which is allowed where a change of its type
    would be. Removing a required field needs two versions that mark it deprecated, under any of its names.
    """
    if "aliases" not in fields.columns:
        fields = fields.withColumn("aliases", F.array().cast("array<string>"))
    fields = fields.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    order = Window.partitionBy("tenant_id").orderBy("version")
    follows = fields.select("tenant_id", "version").distinct().withColumn("next", F.lead("version").over(order)).filter("next IS NOT NULL")
    before = fields.join(follows, ["tenant_id", "version"]).drop("version").withColumnRenamed("next", "version")
    compared = fields.join(follows.select("tenant_id", F.col("next").alias("version")), ["tenant_id", "version"])
    renamed = _renamed(compared, before)
    # How often a field has been marked deprecated so far: in rows of its own name and of the names it had.
    marks = fields.select("tenant_id", "version", F.explode(F.array_union(F.array("name"), "aliases")).alias("name"), F.col("is_deprecated").cast("int").alias("mark"))
    marks = marks.groupBy("tenant_id", "version", "name").agg(F.max("mark").alias("mark"))
    so_far = Window.partitionBy("tenant_id", "name").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.withColumn("deprecated_versions", F.sum("mark").over(so_far)).drop("mark")
    old = before.join(
        counted.join(follows, ["tenant_id", "version"]).drop("version").withColumnRenamed("next", "version"), ["tenant_id", "version", "name"], "left"
    )
    new = compared.join(renamed, ["tenant_id", "version", "name"], "left")
    # Under the old name a renamed field meets its former self.
    verdicts = check_evolution(
        old, new.withColumn("name", F.coalesce("old_name", "name")), ("tenant_id", "version")
    ).withColumnRenamed("name", "__name")
    names = renamed.withColumnRenamed("old_name", "__name")
    kept = F.col("change").isin("unchanged", "type_changed", "made_required") & F.col("name").isNotNull()
    return verdicts.join(names, ["tenant_id", "version", "__name"], "left").select(
        "tenant_id", "version", F.coalesce("name", "__name").alias("name"), F.when(kept, F.col("__name")).alias("old_name"),
        "old_type", "new_type", F.when(kept & (F.col("change") != "made_required"), "renamed").otherwise(F.col("change")).alias("change"), "is_allowed",
    )


def _against_previous(fields: DataFrame) -> DataFrame:
    """One row per tenant, version and field name with the field in this version and the one before.

    Versions count up by one, so every field row is also the "before" of the next version: grouping the
    two copies finds the predecessor without ordering a tenant's versions. The last version has a
    successor here that does not exist; its rows have no field of their own.
    """
    state = F.struct("inferred_type", "is_deprecated").alias("state")
    copies = F.array(
        F.struct(F.col("version").alias("version"), F.lit("now").alias("at")),
        F.struct((F.col("version") + 1).alias("version"), F.lit("before").alias("at")),
    )
    rows = fields.select("tenant_id", "name", state, F.explode(copies).alias("c"))

    def side(at: str, part: str) -> Column:
        return F.max(F.when(F.col("c.at") == at, F.col(f"state.{part}")))

    pairs = rows.groupBy("tenant_id", F.col("c.version").alias("version"), "name").agg(
        side("before", "inferred_type").alias("old_type"),
        side("now", "inferred_type").alias("new_type"),
        side("before", "is_deprecated").alias("was_deprecated"),
        side("now", "is_deprecated").alias("is_deprecated"),
    )
    change = (
        F.when(F.col("version") == 1, None)
        .when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("is_deprecated") & ~F.col("was_deprecated"), "deprecated")
        .when(F.col("new_type") != F.col("old_type"), "type_changed")
    )
    return pairs.withColumn("change", change)


def schema_changes(fields: DataFrame) -> DataFrame:
    """Added, removed, deprecated and retyped fields of each version against the one before."""
    changed = _against_previous(fields).filter(F.col("change").isNotNull())
    return changed.join(latest_version(fields).withColumnRenamed("version", "__last"), "tenant_id").filter(
        F.col("version") <= F.col("__last")
    ).select("tenant_id", "version", "name", "change", "old_type", "new_type")


def schema_history(fields: DataFrame) -> DataFrame:
    """Field count and change counts of every version."""

    def times(change: str) -> Column:
        return F.count_if(F.col("change") == change).alias(change)

    counted = _against_previous(fields).groupBy("tenant_id", "version").agg(
        F.count("new_type").alias("field_count"), times("added"), times("removed"), times("deprecated"), times("type_changed")
    )
    return counted.filter("field_count > 0")
