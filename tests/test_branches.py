"""Seen sets, the hot store's locator, and the search branch of ingest, each with repeated batches."""

from __future__ import annotations

import datetime as dt
import glob
import os
import threading

from pyspark.sql import functions as F

from loglake.operators.joins import missing_ids
from loglake.operators.search_index import Index, matching
from loglake.plans.fixtures import AS_OF, dtos, entries
from loglake.session import new_path
from loglake.sinks import tables as K
from loglake.sinks.seen import accept_new, expire_seen, seen_set
from loglake.sources.files import path_exists, read_archive
from loglake.streaming import jobs as J

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def _ids(spark, *ids):
    return spark.createDataFrame([("t", i, n) for n, i in enumerate(ids)], "tenant_id string, id string, n int")


def _taken(df):
    return sorted((r.id, r.n) for r in df.collect())


def test_an_id_returns_after_its_time_and_sinks_are_apart(spark):
    root = new_path(spark, "seen")
    at = [str(T0 + dt.timedelta(hours=h)) for h in (0, 23, 25, 60)]
    assert _taken(accept_new(_ids(spark, "a", "b", "a"), root, "storage", 0, at[0], order=["n"])) == [("a", 0), ("b", 1)]
    assert _taken(accept_new(_ids(spark, "a", "c"), root, "storage", 1, at[1])) == [("c", 1)]
    assert _taken(accept_new(_ids(spark, "a", "c"), root, "search", 1, at[1])) == [("a", 0), ("c", 1)]
    assert _taken(accept_new(_ids(spark, "a", "c"), root, "storage", 2, at[2])) == [("a", 0)]
    # Repeated batches answer as before, also when later ones have run.
    assert _taken(accept_new(_ids(spark, "a", "c"), root, "storage", 1, at[1])) == [("c", 1)]
    assert _taken(accept_new(_ids(spark, "a", "b", "a"), root, "storage", 0, at[0], order=["n"])) == [("a", 0), ("b", 1)]
    assert expire_seen(spark, root, at[3]) == 2  # the first day of both sinks; the second day is not over
    assert not path_exists(spark, f"{root}/sink=search/day=2024-01-01")


def test_expired_days_change_no_answer(spark):
    root = new_path(spark, "seen")
    for i, day in enumerate((0, 1, 2)):
        accept_new(_ids(spark, f"x{day}"), root, "s", i, str(T0 + dt.timedelta(days=day)))
    now = str(T0 + dt.timedelta(days=2, hours=1))
    before = seen_set(spark, root, "s", now).collect()
    assert expire_seen(spark, root, now) == 1
    assert seen_set(spark, root, "s", now).collect() == before and [r.id for r in before] == ["x2"]


def _state(spark, root):
    return sorted((r.tenant_id, r.id, str(r.event_date), r.level) for r in spark.read.parquet(root).collect())


def test_locator_follows_moves_and_repeats(spark):
    root = new_path(spark, "hot")
    rows = entries(spark, SF)
    moved = rows.filter("id % 7 = 0").withColumns(
        {
            "level": F.lit("Moved"),
            "timestamp_unix_ms": F.col("timestamp_unix_ms") + 86_400_000 * (1 + F.col("id").cast("int") % 3),
            "ingested_at": F.col("ingested_at") + F.expr("INTERVAL 40 DAYS"),
        }
    )
    K.upsert_hot(rows, root)
    K.upsert_hot(moved, root)
    once = _state(spark, root)
    for batch in (moved, rows, moved):
        K.upsert_hot(batch, root)
    assert _state(spark, root) == once and len(once) == rows.count()
    located = sorted((r.tenant_id, r.id, str(r.event_date)) for r in K._locate(spark, root).collect())
    assert located == [s[:3] for s in once]
    K.compact_locator(spark, root)
    assert spark.read.parquet(f"{root}/{K.LOCATOR}").count() == len(once)
    assert sorted((r.tenant_id, r.id, str(r.event_date)) for r in K._locate(spark, root).collect()) == located


def test_a_small_batch_reads_only_its_partitions(spark):
    root = new_path(spark, "hot")
    rows = entries(spark, SF)
    assert K.upsert_hot(rows, root) == 0
    day = rows.filter(F.to_date(F.timestamp_millis("timestamp_unix_ms")) == "2024-01-09").filter("tenant_id = 'tenant-1'")
    assert K.upsert_hot(day.limit(2), root) == 1
    # A row that moves from the tenth to the ninth touches both.
    ten = rows.filter(F.to_date(F.timestamp_millis("timestamp_unix_ms")) == "2024-01-10").filter("tenant_id = 'tenant-1'").limit(1)
    back = ten.withColumns({"timestamp_unix_ms": F.col("timestamp_unix_ms") - 86_400_000, "ingested_at": F.col("ingested_at") + F.expr("INTERVAL 1 DAY")})
    assert K.upsert_hot(back, root) == 2
    assert spark.read.parquet(root).count() == rows.count()


def test_a_store_without_a_locator_gets_one(spark):
    root = new_path(spark, "hot")
    K.upsert_hot(entries(spark, SF), root)
    before = _state(spark, root)
    K.delete_path(spark, f"{root}/{K.LOCATOR}")
    K.upsert_hot(entries(spark, SF).limit(5), root)
    assert _state(spark, root) == before


def test_archive_and_hot_store_agree_after_a_repeated_batch(spark):
    landed, hot, archive, seen, index = (new_path(spark, n) for n in ("landed", "hot", "archive", "seen", "index"))
    checkpoint = new_path(spark, "ckpt")
    rows = dtos(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn(
        "id", F.concat(F.lit("c-"), (F.col("event_id") % 300).cast("string"))
    )
    for part in range(3):
        rows.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(landed)

    def stream():
        return J.file_stream(spark, landed, rows.schema, max_files=1)

    def branch():
        J.search_branch(stream(), F.col("tenant_id"), AS_OF, AS_OF, hot, seen, checkpoint, index).awaitTermination()

    J.ingest_stream(stream(), F.col("tenant_id"), AS_OF, AS_OF, archive, new_path(spark, "ckpt")).awaitTermination()
    branch()
    once = _state(spark, hot)
    # Forget that the last batch was done: it is run again.
    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for path in (last, f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        if os.path.exists(path):
            os.remove(path)
    branch()
    assert _state(spark, hot) == once
    stored = read_archive(spark, archive)
    assert missing_ids(stored, spark.read.parquet(hot)).count() == 0
    assert missing_ids(spark.read.parquet(hot), stored).count() == 0
    keys = matching(Index(spark, index, "tenant_id string, id string"), None)
    assert keys.count() == keys.distinct().count() == len(once)


def test_sinks_run_at_once_each_with_its_seen_set(spark):
    """Two sinks wait for each other, which they could not one after the other; one fails; a repeat changes nothing."""
    seen, stores = new_path(spark, "seen"), {n: new_path(spark, n) for n in ("storage", "search")}
    setting = spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize")

    def run(batch, batch_id, at, names=("storage", "search")):
        meet = threading.Barrier(len(names), timeout=60)

        def sink(name):
            def write(rows):
                meet.wait()
                K.upsert_hot(accept_new(rows, seen, name, batch_id, str(at)), stores[name])

            return write

        def broken(_):
            raise RuntimeError("sink is down")

        return K.fan_out(batch, {n: sink(n) for n in names} | {"broken": broken})

    rows = entries(spark, SF)
    first, second = rows.filter("id % 2 = 0"), rows.filter("id % 4 < 2")
    assert run(first, 0, T0) == {"broken": "RuntimeError: sink is down"}
    run(second.withColumn("level", F.lit("Again")), 1, T0 + dt.timedelta(hours=1), ("storage",))
    run(first, 0, T0)
    # The storage sink has seen the ids of both batches, the search sink those of the first.
    state = _state(spark, stores["storage"])
    assert len(state) == rows.filter("id % 2 = 0 OR id % 4 < 2").count()
    assert {s[1] for s in state if s[3] == "Again"} == {r.id for r in second.filter("id % 2 <> 0").collect()}
    assert len(_state(spark, stores["search"])) == first.count()
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize") == setting
