"""Connected components of link tables by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` has ``a``, ``b`` (numbers, any order). Returns ``id, component_id``: every linked
    id with the smallest id it reaches; ids without links are absent.

    Each round hangs the larger neighbours of every id, then its smaller ones, on the smallest
    neighbour. A round is two aggregations and two joins; the result is written to shared storage.
    No neighbourhood is collected. An empty table gives an empty one."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    while True:
        near = both(edges)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b"), "m", "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stored(small, "links")
        after = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if after == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        before = after
