"""Registered queries: a Spark callable each, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglake.session import new_path, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return plain_times(fn(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def plain_times(df: DataFrame) -> DataFrame:
    """UTC wall-clock timestamps without zone, the type the input tables use."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def rounded(col, digits: int = 6):
    """Value for comparison. The shift keeps exact halves, which engines round differently, off the edge."""
    return F.round((F.col(col) if isinstance(col, str) else col) + 1e-9, digits)


_written: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Write a table once per session and data folder, and hand out its path afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = new_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]
