"""Replicated and augmented features: seeded by hashes, so every run and partitioning gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from .rounds import Steps


def grid_offset(i: Column, n: int, width: Column, height: Column, variant: Column | int = 0) -> tuple[Column, Column]:
    """Place of the i-th of n cells of a row-major grid; variants start 0.35 of a step further on."""
    cols = max(1, round(n**0.5 + 0.4999))
    rows = max(1, -(-n // cols))
    dx, dy = width / cols, height / rows
    v = F.lit(variant) if isinstance(variant, int) else variant
    return (i % cols) * dx + v * 0.35 * dx, F.floor(i / cols) * dy + v * 0.35 * dy


def shifted(line: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """Moved and clamped to the raster."""
    move = lambda v, d, size: F.least(F.greatest(v + d, F.lit(0.0)), size - 1.0)
    return F.transform(line, lambda p: L.point(move(p["x"], dx, width), move(p["y"], dy, height)))


def replicated(features: DataFrame, key: list[str], wanted: int) -> DataFrame:
    """``wanted`` features a key: the key's features (feature_id) in order, again and again; copy numbers them and props' Id gets it as a suffix."""
    w = Window.partitionBy(*key)
    f = features.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("feature_id")) - 1)
    # feature i comes at i, i + n, i + 2 n, ...
    last = F.lit(wanted - 1)
    return f.where(F.col("i") <= last).withColumn("copy", F.explode(F.sequence(F.col("i").cast("int"), last, F.col("n").cast("int")))).drop("n", "i")


def augment_params(seed: Column, p_rotate: float, p_h: float, p_v: float) -> Column:
    """struct of rot (0 to 3 quarter turns), h and v, from a hash of the seed."""
    u = lambda k: F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(1_000_000)) / 1e6
    rot = F.when(u(1) < p_rotate, F.pmod(F.xxhash64(seed, F.lit(2)), F.lit(3)) + 1).otherwise(0).cast("int")
    return F.struct(rot.alias("rot"), (u(3) < p_h).alias("h"), (u(4) < p_v).alias("v"))


def augmented(line: Column, size: int, rot: Column, h: Column, v: Column) -> Column:
    """Quarter turns (x, y) -> (y, size - 1 - x), then the horizontal and the vertical flip."""
    e = F.lit(float(size - 1))

    def one(p: Column) -> Column:
        x = F.when(rot == 1, p["y"]).when(rot == 2, e - p["x"]).when(rot == 3, e - p["y"]).otherwise(p["x"])
        y = F.when(rot == 1, e - p["x"]).when(rot == 2, e - p["y"]).when(rot == 3, p["x"]).otherwise(p["y"])
        return L.point(F.when(h, e - x).otherwise(x), F.when(v, e - y).otherwise(y))

    return F.transform(line, one)


def in_order(rows: DataFrame, by: str, number: str) -> DataFrame:
    """``rows`` with their place (from 0) by a column, over the whole table: they are sorted in ranges, each a task of its own, and only the ranges' sizes, a row a range, meet in one place."""
    ranged = Steps(rows.sparkSession).kept(rows.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1)
    return own.join(before, "_range").withColumn(number, (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def round_robin(epochs: DataFrame, samples: DataFrame) -> DataFrame:
    """epoch and the sample whose turn it is: the ((epoch - 1) mod n)-th by sample_id."""
    turns = in_order(samples.select("sample_id"), "sample_id", "turn")
    n = turns.count()
    return epochs.withColumn("turn", (F.col("epoch") - 1) % max(1, n)).join(turns, "turn").select("epoch", "sample_id")


def sample_dir(path: Column, inside: str) -> Column:
    """The folder of the sample that an image lies in, ``inside`` being the image's own path there."""
    return F.regexp_extract(path, "^(.*?)/" + "/".join(["[^/]+"] * (inside.count("/") + 1)) + "$", 1)
