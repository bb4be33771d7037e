from __future__ import annotations

import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglake.operators import dedup as D

T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(
        [("t", key, T0 + dt.timedelta(minutes=m), i) for i, (key, m) in enumerate(rows)],
        "tenant_id string, id string, ingested_at timestamp, delivery long",
    )


def accepted_by_hand(rows, ttl):
    """Walk through the deliveries in time order, as a key store with expiry would."""
    until, taken = {}, set()
    for i, (key, m) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        if key not in until or m >= until[key]:
            until[key] = m + ttl
            taken.add(i)
    return taken


def check(spark, rows, ttl):
    marked = D.mark_first_seen(frame(spark, rows), f"{ttl} MINUTES", tie=["delivery"]).collect()
    assert len(marked) == len(rows)
    assert {r.delivery for r in marked if r.is_new} == accepted_by_hand(rows, ttl)


def test_ttl_against_a_walk_with_a_hot_id(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(400)) for i in range(600)]
    check(spark, rows, 100)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 60)), min_size=1, max_size=25), st.integers(1, 40))
def test_ttl_against_a_walk(spark, rows, ttl):
    check(spark, rows, ttl)


def test_same_key_within_and_after_expiry(spark):
    check(spark, [("a", 0), ("a", 1), ("b", 1), ("a", 59), ("a", 60), ("a", 119), ("a", 120)], 60)


def test_keep_first_is_idempotent(spark):
    rng = random.Random(3)
    df = frame(spark, [("hot" if i % 3 == 0 else f"k{rng.randrange(30)}", rng.randrange(100)) for i in range(300)])
    order = ["ingested_at", "delivery"]
    once = D.keep_first(df, order=order)
    assert sorted(once.collect()) == sorted(D.keep_first(once, order=order).collect())
    assert once.count() == df.select("id").distinct().count()


def test_seen_sets_are_separate_per_sink_and_expire(spark):
    df = frame(spark, [("a", 0), ("b", 0), ("c", 0)])
    seen = spark.createDataFrame(
        [("storage", "t", "a", T0 + dt.timedelta(hours=1)), ("search", "t", "b", T0 + dt.timedelta(hours=1)), ("storage", "t", "c", T0)],
        "sink string, tenant_id string, id string, expires_at timestamp",
    )
    now = F.lit(str(T0)).cast("timestamp")
    assert {r.id for r in D.drop_seen(df, seen, now, "storage").collect()} == {"b", "c"}
    assert {r.id for r in D.drop_seen(df, seen, now, "search").collect()} == {"a", "c"}


def test_duplicate_rate_bands(spark):
    rows = [("t1", "x"), ("t1", "x")] + [("t2", str(i)) for i in range(50)] + [("t2", "0")]
    df = spark.createDataFrame(rows, "tenant_id string, id string")
    got = {r.tenant_id: (r.ingested, r.skipped, r.band) for r in D.duplicate_rate(df).collect()}
    assert got == {"t1": (2, 1, "critical"), "t2": (51, 1, "elevated")}
