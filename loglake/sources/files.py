"""Reading log files: NDJSON, JSON arrays, flat Parquet and the partitioned archive."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglake import schema
from loglake.operators.filters import partition_range, time_range
from loglake.plans.logs_view import canonical_logs

_CORRUPT = "_corrupt"
# Folder of streamed files below an archive; Spark passes over names that begin with an underscore when it lists.
STREAMED = "_streamed"
_SCHEME = r"^[A-Za-z0-9+.-]+:/+"


def key_of(path: str) -> str:
    """The key of a path: without its scheme, which Spark writes in more than one way."""
    return re.sub(_SCHEME, "/", path)


def key_column() -> Column:
    """`key_of` the file that a row was read from."""
    return F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "/")


def parse_ndjson(lines: DataFrame, row_type: T.StructType = schema.LOG_ENTRY) -> tuple[DataFrame, DataFrame]:
    """Split text lines into (rows, unparsable lines). Blank lines are in neither."""
    with_corrupt = T.StructType(row_type.fields + [T.StructField(_CORRUPT, T.StringType())])
    parsed = lines.filter(F.col("value").rlike(r"\S")).select(
        "value",
        F.from_json(
            "value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        ).alias("row"),
    )
    good = parsed.filter(F.col(f"row.{_CORRUPT}").isNull()).select("row.*").drop(_CORRUPT)
    bad = parsed.filter(F.col(f"row.{_CORRUPT}").isNotNull()).select(
        F.col("value").alias("raw"), F.array(F.lit("invalid JSON")).alias("reason")
    )
    return good, bad


def read_ndjson(
    spark: SparkSession, path: str, tenant_id: str, row_type: T.StructType = schema.LOG_ENTRY
) -> DataFrame:
    """Entries of newline-delimited JSON files; `.gz` files are decompressed by Spark.

    The tenant is the job's, whatever the file says. Unparsable lines are left out here; take them
    from `parse_ndjson` to quarantine them.
    """
    good, _ = parse_ndjson(spark.read.text(path), row_type)
    return good.withColumn("tenant_id", F.lit(tenant_id))


def read_json_array(
    spark: SparkSession, path: str, tenant_id: str, row_type: T.StructType = schema.LOG_ENTRY
) -> DataFrame:
    """Entries of files that are one JSON array each. Every file is one task, so keep files small."""
    rows = spark.read.schema(row_type).option("multiLine", True).json(path)
    return rows.withColumn("tenant_id", F.lit(tenant_id))


def pull_new_files(
    spark: SparkSession, directory: str, last_key: str | None, tenant_id: str, glob: str = "*"
) -> tuple[DataFrame, DataFrame]:
    """(entries of files whose key is greater than `last_key`, one row with the new key).

    Only the file listing is needed to choose the files; keys (see `key_of`) compare by their bytes.
    """
    keys = file_keys(spark, directory, glob)
    fresh = keys if last_key is None else keys.filter(F.col("key") > last_key)
    lines = (
        spark.read.option("pathGlobFilter", glob)
        .text(directory)
        .select("value", key_column().alias("key"))
    )
    if last_key is not None:
        lines = lines.filter(F.col("key") > last_key)
    good, _ = parse_ndjson(lines.select("value"))
    state = fresh.agg(F.max("key").alias("last_key"))
    return good.withColumn("tenant_id", F.lit(tenant_id)), state


def file_keys(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Path and size of every file, in key order. Contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(directory)
    )
    return files.select(key_column().alias("key"), F.col("length").alias("bytes")).orderBy("key")


def read_archive(
    spark: SparkSession,
    root: str,
    tenant: str | None = None,
    t_from: dt.datetime | None = None,
    t_to: dt.datetime | None = None,
) -> DataFrame:
    """The `logs` view over the archive for a tenant and time range, pruned to its directories.

    With a tenant only that tenant's folder is listed, with a time range as well only its months:
    listing every hour of every tenant would cost more than many queries.
    """
    if tenant is None:
        paths = [p for p in [root] if path_exists(spark, p)]
    else:
        paths = _tenant_paths(spark, root, tenant, t_from, t_to)
    rows = archive_rows(spark, root, paths)
    if tenant is not None:
        rows = rows.filter(F.col("tenant_id") == tenant)
    logs = canonical_logs(partition_range(rows, t_from, t_to))
    return time_range(logs, t_from, t_to)


def archive_rows(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Rows of the given folders and of what streams have committed below the root.

    Streamed files are listed by the stream's own log, so those of a failed batch are not read; files that a
    tenant's deletion took away are passed over.
    """
    streamed = f"{root}/{STREAMED}"
    reader = spark.read.schema(archive_schema())
    rows = reader.option("basePath", root).parquet(*paths) if paths else None
    if path_exists(spark, f"{streamed}/_spark_metadata"):
        more = spark.read.schema(archive_schema()).option("ignoreMissingFiles", "true").parquet(streamed)
        rows = more if rows is None else rows.unionByName(more)
    return spark.createDataFrame([], archive_schema()) if rows is None else rows


def _tenant_paths(
    spark: SparkSession, root: str, tenant: str, t_from: dt.datetime | None, t_to: dt.datetime | None
) -> list[str]:
    base = f"{root}/{tenant_folder(spark, tenant)}"
    if t_from is None or t_to is None:
        return [p for p in [base] if path_exists(spark, p)]
    first, last = t_from.year * 12 + t_from.month - 1, t_to.year * 12 + t_to.month - 1
    months = [f"{base}/year={m // 12:04d}/month={m % 12 + 1:02d}" for m in range(first, last + 1)]
    return [p for p in months if path_exists(spark, p)]


def tenant_folder(spark: SparkSession, tenant: str) -> str:
    """The tenant's partition folder, written as Spark writes it: some characters are escaped."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(tenant)
    return f"tenant_id={escaped}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def archive_schema() -> T.StructType:
    """Archived columns plus the partition strings, which must stay strings (``01``, not 1)."""
    parts = [T.StructField(c, T.StringType()) for c in schema.PARTITION_COLUMNS]
    rest = [f for f in schema.LOG_ENTRY.fields if f.name != "tenant_id"]
    return T.StructType(rest + [T.StructField("timestamp", T.TimestampType())] + parts)


def read_merged(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files of several schema versions: union of columns, NULL where one is missing.

    Columns whose types conflict make the read fail.
    """
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def union_versions(first: DataFrame, *more: DataFrame) -> DataFrame:
    """The same for frames."""
    out = first
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
