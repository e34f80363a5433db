"""Connected components over edge tables, without gathering edges or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import hot_keys, join_one
from .storage import Workspace


def components(edges: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """(id, label): the least id that each id of ``edges`` (a, b) connects to. Each round takes the least label among
    neighbours and then follows labels once, so rounds grow with the logarithm of a component's length. Ids with very many edges, and labels of very many ids, are dealt to many tasks."""
    both = space.written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("u", "v"), f"{name}-edges")
    hubs = space.written(hot_keys(both.groupBy("u").agg(F.count("*").alias("n")), ["u"]), f"{name}-hubs")
    labels = space.written(both.groupBy(F.col("u").alias("id")).agg(F.least("u", F.min("v")).alias("label")), f"{name}-0")
    n = 0
    while True:
        n += 1
        near = join_one(both, labels.withColumnRenamed("id", "u"), ["u"], hubs).groupBy(F.col("v").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        follow = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        common = space.written(hot_keys(labels.groupBy("label").agg(F.count("*").alias("n")), ["label"]), f"{name}-common-{n}")
        new = space.written(join_one(lower, follow, ["label"], common, "left").select("id", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("changed")), f"{name}-{n}")
        moved = new.where("changed").limit(1).count()
        labels = new.select("id", "label")
        for done in (f"{name}-{n - 1}", f"{name}-common-{n}"):
            space.remove(done)
        if not moved:
            space.remove(f"{name}-edges")
            space.remove(f"{name}-hubs")
            return labels
