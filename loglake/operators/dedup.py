"""Duplicate handling.

One id may hold a large part of all rows, so nothing here gathers the copies of an id: they are reduced
by `min_by` / `max_by` / `count`, which Spark combines on the map side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.functions.columns import interval
from loglake.session import ensure_checkpoint_dir

KEY = ["tenant_id", "id"]


def _pick(df: DataFrame, keys: list[str], order: list[str], newest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    choose = F.max_by if newest else F.min_by
    return (
        df.groupBy(*keys)
        .agg(choose(F.struct(*rest), rank).alias("__row"))
        .select(*keys, "__row.*")
        .select(*df.columns)
    )


def keep_first(df: DataFrame, keys: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """First row per key. `order` should be a total order if the choice must be repeatable."""
    return _pick(df, keys, order or ["ingested_at"], newest=False)


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key, as an upsert table holds it."""
    return _pick(df, keys, order, newest=True)


def drop_seen(df: DataFrame, seen: DataFrame, as_of: Column, sink: str | None = None) -> DataFrame:
    """Rows whose id is not in the unexpired part of the seen set.

    The seen keys are made distinct first, so a hot id cannot multiply rows; AQE splits a hot key on
    the probing side.
    """
    live = seen.filter(F.col("expires_at") > as_of)
    if sink is not None:
        live = live.filter(F.col("sink") == sink)
    return df.join(live.select(*KEY).distinct(), KEY, "left_anti")


def _sessions(df: DataFrame, ttl: str, keys: list[str]) -> DataFrame:
    """keys, first (the earliest ``__t``), last (the latest time) of every stretch of an id's occurrences without a gap of
    ``ttl``. Rows are reduced to one per id and half a ``ttl`` before anything is sorted."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    step = F.unix_micros((epoch + interval(ttl)).cast("timestamp")) / 2
    slot = F.floor(F.unix_micros(F.col("__t.t").cast("timestamp")) / step)
    slots = df.groupBy(*keys, slot.alias("__slot")).agg(F.min("__t").alias("first"), F.max("__t.t").alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("__slot")
    begins = F.lag("last").over(earlier)
    marked = slots.withColumn("__new", (begins.isNull() | (F.col("first.t") >= begins + interval(ttl))).cast("int"))
    numbered = marked.withColumn("__session", F.sum("__new").over(earlier))
    return numbered.groupBy(*keys, "__session").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def ttl_first_seen(
    df: DataFrame,
    ttl: str = "24 HOURS",
    keys: list[str] = KEY,
    ts: str = "ingested_at",
    tie: list[str] | None = None,
) -> DataFrame:
    """The occurrences accepted when an id is remembered for `ttl` after each acceptance.

    Returns keys, time and the `tie` columns that order rows of equal time. The first of every stretch without a gap of
    `ttl` is accepted, and nothing else of a stretch shorter than `ttl`: without long chains one pass does. Only the
    rest of longer stretches goes through rounds, each of which takes the earliest remaining occurrence of a stretch and
    drops what falls within `ttl` after it: one map-side combined aggregation and a join against one row per stretch.
    A hot id is never held in one place.
    """
    tie = tie or []
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(*keys, F.struct(F.col(ts).alias("t"), *tie).alias("__t"))
    sessions = _sessions(rows, ttl, keys).checkpoint()
    accepted = sessions.select(*keys, F.col("first").alias("__a"))
    # By session, since the later of two may begin before the earlier one's rounds end.
    key = [*keys, "__session"]
    chains = sessions.filter(F.col("last") >= F.col("first.t") + interval(ttl))
    later = (F.col("__t.t") >= F.col("first.t") + interval(ttl)) & (F.col("__t.t") <= F.col("last"))
    remaining = rows.join(chains, keys).filter(later).select(*key, "__t").checkpoint()
    while not remaining.isEmpty():
        first = remaining.groupBy(*key).agg(F.min("__t").alias("__a")).checkpoint()
        accepted = accepted.unionByName(first.select(*keys, "__a"))
        remaining = (
            remaining.join(first, key)
            .filter(F.col("__t.t") >= F.col("__a.t") + interval(ttl))
            .drop("__a")
            .checkpoint()
        )
    return accepted.select(*keys, F.col("__a.t").alias(ts), *[F.col(f"__a.{c}") for c in tie])


COPIES = 65536


def mark_first_seen(
    df: DataFrame,
    ttl: str = "24 HOURS",
    keys: list[str] = KEY,
    ts: str = "ingested_at",
    tie: list[str] | None = None,
) -> DataFrame:
    """Add `is_new`: whether the row is an accepted occurrence of its id.

    Rows of equal time are ordered by `tie`, or by a hash of all their columns; of rows that are equal in every column one
    is accepted. Such copies are counted and written out again, since nothing tells them apart.
    """
    if tie is None:
        marked = df.withColumn("__tie", F.xxhash64(F.to_json(F.struct("*"))))
        return _one_of_equal(mark_first_seen(marked, ttl, keys, ts, ["__tie"]), [*keys, ts, "__tie"]).drop("__tie")
    accepted = ttl_first_seen(df, ttl, keys, ts, tie).withColumn("__new", F.lit(True))
    return (
        df.join(accepted, [*keys, ts, *tie], "left")
        .withColumn("is_new", F.coalesce("__new", F.lit(False)))
        .drop("__new")
    )


def _one_of_equal(marked: DataFrame, equal: list[str]) -> DataFrame:
    """New rows that agree in ``equal`` are one new row and its copies, which are not new."""
    names = [c for c in marked.columns if c not in equal]
    new = marked.filter("is_new").groupBy(*equal).agg(F.first(F.struct(*names)).alias("__row"), F.count(F.lit(1)).alias("__n"))
    one = new.select(*equal, "__row.*")
    # Copies of a hot row are written by several tasks.
    parts = new.filter("__n > 1").withColumn("__p", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 2) / COPIES)))).hint("rebalance", "__p")
    size = F.least(F.col("__n") - 1 - F.col("__p") * COPIES, F.lit(COPIES)).cast("int")
    copies = parts.withColumn("__i", F.explode(F.sequence(F.lit(1), size))).select(*equal, "__row.*").withColumn("is_new", F.lit(False))
    rest = marked.filter("NOT is_new")
    return rest.unionByName(one).unionByName(copies).select(*marked.columns)


def duplicates(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Ids held by two or more rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies >= 2")


def duplicate_rate(df: DataFrame) -> DataFrame:
    """Share of repeated rows per tenant, in percent, with its alarm band."""
    per_id = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    rate = per_id.groupBy("tenant_id").agg(
        F.sum("n").alias("ingested"), F.sum(F.col("n") - 1).alias("skipped")
    )
    pct = 100.0 * F.col("skipped") / F.col("ingested")
    band = F.when(pct >= 10, "critical").when(pct >= 5, "high").when(pct >= 1, "elevated").otherwise("normal")
    return rate.withColumns({"duplicate_pct": pct, "band": band})
