"""Spatial joins by grid cells that split where features crowd.

Boxes are dealt to cells of a fixed size. A cell in which more than ``MOST`` of them meet becomes a quadtree's part: 4, 16, ... cells, as many as bring it down to that number, but none smaller than the boxes in it
are on average, as these would only be dealt to more cells. So a crowded place is work for many tasks, with fewer pairs to look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST, DEEPEST = 64, 8


def _coarse(df: DataFrame, box: list[Column], cell: float) -> DataFrame:
    at = lambda c: F.floor(c / cell).cast("long")
    x0, y0, x1, y1 = box
    return df.withColumn("_cx", F.explode(F.sequence(at(x0), F.greatest(at(x0), at(x1))))).withColumn("_cy", F.explode(F.sequence(at(y0), F.greatest(at(y0), at(y1)))))


def levels(df: DataFrame, key: list[str], box: list[Column], cell: float, most: int = MOST, finest: float = 1e-9) -> DataFrame:
    """key, _cx, _cy, _level of cells that split, into none smaller than ``finest``."""
    x0, y0, x1, y1 = box
    wide = F.greatest(x1 - x0, y1 - y0, F.lit(finest))
    full = _coarse(df.select(*key, *(c.alias(n) for c, n in zip((*box, wide), ("_x0", "_y0", "_x1", "_y1", "_wide"), strict=True))), [F.col(c) for c in ("_x0", "_y0", "_x1", "_y1")], cell)
    crowd = full.groupBy(*key, "_cx", "_cy").agg(F.count("*").alias("_n"), F.avg("_wide").alias("_wide")).where(F.col("_n") > most)
    level = F.least(F.ceil(F.log2(F.col("_n") / most) / 2), F.floor(F.log2(cell / F.col("_wide"))), F.lit(DEEPEST)).cast("int")
    return crowd.select(*key, "_cx", "_cy", level.alias("_level")).where("_level > 0")


def dealt(df: DataFrame, key: list[str], box: list[Column], cell: float, split: DataFrame) -> DataFrame:
    """``df`` with _level, _fx and _fy: a row for each cell, at its level, that the closed box touches."""
    x0, y0, x1, y1 = box
    rows = _coarse(df, box, cell).join(split, [*key, "_cx", "_cy"], "left").withColumn("_level", F.coalesce("_level", F.lit(0)))
    parts = F.pow(F.lit(2.0), F.col("_level"))
    at = lambda c: F.floor(c / (cell / parts)).cast("long")
    low, high = lambda c, v: F.greatest(at(v), (F.col(c) * parts).cast("long")), lambda c, v: F.least(at(v), ((F.col(c) + 1) * parts).cast("long") - 1)
    rows = rows.withColumn("_fx", F.explode(F.sequence(low("_cx", x0), F.greatest(low("_cx", x0), high("_cx", x1)))))
    return rows.withColumn("_fy", F.explode(F.sequence(low("_cy", y0), F.greatest(low("_cy", y0), high("_cy", y1))))).drop("_cx", "_cy")


def met(left: DataFrame, right: DataFrame, key: list[str], left_box: list[Column], right_box: list[Column], cell: float, most: int = MOST, finest: float = 1e-9, tasks: bool = False) -> DataFrame:
    """Pairs of rows whose closed boxes share a cell, each in the one cell that holds the least corner of what the boxes have in common; other columns of the two sides must differ.
    ``tasks``: pairs are dear, so cells are dealt to as many tasks as there are shuffle partitions, however few bytes they hold."""
    split = levels(right, key, right_box, cell, most, finest)
    sides = [dealt(df, key, box, cell, split) for df, box in ((left, left_box), (right, right_box))]
    if tasks:
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sides = [df.repartition(n, *key, "_level", "_fx", "_fy") for df in sides]
    pairs = sides[0].join(sides[1], [*key, "_level", "_fx", "_fy"])
    side = cell / F.pow(F.lit(2.0), F.col("_level"))
    corner = [F.floor(F.greatest(a.cast("double"), b.cast("double")) / side) for a, b in zip(left_box[:2], right_box[:2], strict=True)]
    return pairs.where((corner[0] == F.col("_fx")) & (corner[1] == F.col("_fy"))).drop("_level", "_fx", "_fy")
