"""Seen sets: which ids a sink has taken lately.

Every sink has its own. What a batch takes is stored with the batch, by day, so that a repeated batch decides as it did
the first time and whole days are dropped when their ids have expired.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions.columns import interval
from loglake.operators.dedup import KEY, keep_first
from loglake.sinks.tables import delete_path
from loglake.sources.files import path_exists

SEEN = "tenant_id string, id string, accepted_at timestamp, sink string, day date, batch_id long"


def seen_set(spark: SparkSession, root: str, sink: str, as_of: dt.datetime | str, ttl: str = "24 HOURS", before: int | None = None) -> DataFrame:
    """tenant_id, id of what the sink took within ``ttl`` before ``as_of``, in batches before ``before``."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], "tenant_id string, id string")
    since = F.lit(str(as_of)).cast("timestamp") - interval(ttl)
    rows = spark.read.schema(SEEN).parquet(root).filter((F.col("sink") == sink) & (F.col("day") >= F.to_date(since)))
    rows = rows if before is None else rows.filter(F.col("batch_id") < before)
    return rows.filter(F.col("accepted_at") > since).select(*KEY)


def accept_new(
    batch: DataFrame, root: str, sink: str, batch_id: int, as_of: dt.datetime | str, ttl: str = "24 HOURS", order: list[str] | None = None
) -> DataFrame:
    """The rows of a batch that the sink takes: one per id, of ids it has not taken within ``ttl``; they are remembered.

    Of copies in the batch the first by ``order`` (by all columns, if not given) is taken. Given again, a batch gets the same answer, since it sees only
    batches before it. Only ids are shuffled against the seen set; those of a batch are made distinct first, so a hot id
    is one row.
    """
    spark = batch.sparkSession
    seen = seen_set(spark, root, sink, as_of, ttl, before=batch_id)
    at = F.lit(str(as_of)).cast("timestamp")
    ids = batch.select(*KEY).distinct().join(seen.distinct(), KEY, "left_anti")
    (
        ids.select("*", at.alias("accepted_at"), F.lit(sink).alias("sink"), F.to_date(at).alias("day"), F.lit(batch_id).alias("batch_id"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("sink", "day", "batch_id")
        .parquet(root)
    )
    mine = spark.read.schema(SEEN).parquet(root).filter((F.col("sink") == sink) & (F.col("batch_id") == batch_id)).select(*KEY)
    order = order or [c for c, kind in batch.dtypes if c not in KEY and not kind.startswith("map")]
    return keep_first(batch.join(mine, KEY, "left_semi").select(*batch.columns), KEY, order)


def expire_seen(spark: SparkSession, root: str, as_of: dt.datetime | str, ttl: str = "24 HOURS") -> int:
    """Delete the days whose ids have all expired, of all sinks; returns their number. Only partition names are read."""
    since = F.lit(str(as_of)).cast("timestamp") - interval(ttl)
    old = spark.read.schema(SEEN).parquet(root).select("sink", "day").distinct().filter(F.col("day") < F.to_date(since)).collect()
    for row in old:
        delete_path(spark, f"{root}/sink={row.sink}/day={row.day}")
    return len(old)
