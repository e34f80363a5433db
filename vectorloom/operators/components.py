"""Connected components over edge tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Steps


def components(edges: DataFrame, key: list[str], steps: Steps, name: str = "components") -> DataFrame:
    """key, id, label: for each id of ``edges`` (key, a, b), the least id that it is connected to within its key.

    Each round draws, about every id, first its greater neighbours and then its lesser ones to the least of all; what is left is a star about each component's least id. Neighbourhoods are
    aggregated, never gathered, and rounds grow with the logarithm of a component's size."""
    n = 0
    now = steps.kept(edges.select(*key, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    told = None
    while True:
        both = now.unionByName(now.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*key, "a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.where("b > a").join(low, [*key, "a"]).select(*key, F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy(*key, "a").agg(F.min("b").alias("low"))
        moved = large.join(least, [*key, "a"]).where("b <> low").select(*key, F.col("b").alias("a"), F.col("low").alias("b"))
        small = moved.unionByName(least.select(*key, "a", F.col("low").alias("b"))).distinct()
        n += 1
        now = steps.kept(small, f"{name}-{n}")
        steps.drop(f"{name}-{n - 1}")
        is_now = now.agg(F.count("*"), F.sum(F.xxhash64(*key, "a", "b").cast("decimal(38,0)"))).first()
        if is_now == told:
            return now.select(*key, F.col("a").alias("id"), F.col("b").alias("label")).unionByName(now.select(*key, F.col("b").alias("id"), F.col("b").alias("label")).distinct())
        told = is_now
