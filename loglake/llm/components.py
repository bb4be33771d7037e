"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import stored


def _with_smallest(edges: DataFrame) -> DataFrame:
    """Adds ``m``, the smallest neighbour of ``u`` or ``u`` itself. A hot ``u`` is reduced before the shuffle, and the
    join with the stored minima can be split."""
    smallest = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return edges.join(stored(smallest, "smallest"), "u")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in ``links`` (a, b); self-links and repeats are fine.

    Every round writes its links to the shared folder; the number of rounds grows with the logarithm of the longest
    path.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stored(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = _with_smallest(stored(large, "large"))
        small = star.select("u", F.col("m").alias("v")).unionByName(
            star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = stored(small.distinct(), "links")
        now = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # Now a forest of stars: each id has one link, to the smallest id of its component.
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
