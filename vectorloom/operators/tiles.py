"""Tile windows over rasters: generation, review-mask coverage, audited selection and scan order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _positions(start: Column, end: Column, limit: Column, tile: int, stride: int) -> Column:
    """Where tiles begin along one axis: every stride, and flush with the region's end. A region that fits gives one place, an empty one zero."""
    low, high = F.greatest(start, F.lit(0)), F.least(end, limit)
    inside = F.greatest(limit - tile, F.lit(0))
    last = F.least(F.greatest(high - tile, F.lit(0)), inside)
    steps = F.transform(F.sequence(low, F.greatest(last, low), F.lit(stride)), lambda p: F.least(p, last))
    return F.when(high <= low, F.array(F.lit(0).cast("long"))).when(high - low <= tile, F.array(F.least(low, inside))).otherwise(F.array_sort(F.array_distinct(F.concat(steps, F.array(last)))))


def keep_box(tile: list[Column], width: Column, height: Column, margin: int) -> list[Column]:
    """The tile without its margin, except along the raster's edges."""
    x0, y0, x1, y1 = tile
    m = max(0, margin)
    return [
        F.when(x0 <= 0, x0).otherwise(F.least(x1, x0 + m)),
        F.when(y0 <= 0, y0).otherwise(F.least(y1, y0 + m)),
        F.when(x1 >= width, x1).otherwise(F.greatest(x0, x1 - m)),
        F.when(y1 >= height, y1).otherwise(F.greatest(y0, y1 - m)),
    ]


def expand_box(box: list[Column], pad: int, width: Column, height: Column) -> list[Column]:
    """Padded and clamped; a null box is the whole raster."""
    x0, y0, x1, y1 = box
    zero = F.lit(0)
    return [F.coalesce(F.greatest(zero, x0 - pad), zero), F.coalesce(F.greatest(zero, y0 - pad), zero), F.coalesce(F.least(width, x1 + pad), width), F.coalesce(F.least(height, y1 + pad), height)]


def generate(rasters: DataFrame, tile: int, overlap: int, keep_margin: int = 0, region: list[str] | None = None) -> DataFrame:
    """sample_id, width, height, candidate_index (row by row) and the tile's and keep boxes. ``region`` names four columns of a box to search; null ones mean the whole raster."""
    tile = max(1, tile)
    stride = max(1, tile - max(0, min(overlap, tile - 1)))
    w, h = F.col("width").cast("long"), F.col("height").cast("long")
    x0, y0, x1, y1 = (F.coalesce(F.col(c).cast("long"), d) for c, d in zip(region, (F.lit(0), F.lit(0), w, h), strict=True)) if region else (F.lit(0).cast("long"), F.lit(0).cast("long"), w, h)
    rows = rasters.select("sample_id", w.alias("width"), h.alias("height"), _positions(x0, x1, w, tile, stride).alias("xs"), _positions(y0, y1, h, tile, stride).alias("ys"))
    rows = rows.select("sample_id", "width", "height", "xs", F.posexplode("ys").alias("iy", "y0")).select("sample_id", "width", "height", "iy", "y0", F.size("xs").alias("nx"), F.posexplode("xs").alias("ix", "x0"))
    rows = rows.withColumn("x1", F.least("width", F.col("x0") + tile)).withColumn("y1", F.least("height", F.col("y0") + tile)).withColumn("candidate_index", F.col("iy") * F.col("nx") + F.col("ix"))
    keep = keep_box([F.col(c) for c in ("x0", "y0", "x1", "y1")], F.col("width"), F.col("height"), keep_margin)
    return rows.select("sample_id", "width", "height", F.col("candidate_index").cast("long").alias("candidate_index"), "x0", "y0", "x1", "y1", *(k.alias(f"keep_{n}") for k, n in zip(keep, ("x0", "y0", "x1", "y1"), strict=True)))


def whole(rasters: DataFrame) -> DataFrame:
    """One tile a raster, for when tiling is off."""
    w, h = F.col("width").cast("long"), F.col("height").cast("long")
    zero = F.lit(0).cast("long")
    return rasters.select("sample_id", w.alias("width"), h.alias("height"), zero.alias("candidate_index"), zero.alias("x0"), zero.alias("y0"), w.alias("x1"), h.alias("y1"), zero.alias("keep_x0"), zero.alias("keep_y0"), w.alias("keep_x1"), h.alias("keep_y1"), F.lit("tiling_disabled").alias("reason"))


def mask_box(mask: DataFrame) -> DataFrame:
    """Extent of reviewed blocks (sample_id, x0, y0, x1, y1) for each sample."""
    return mask.groupBy("sample_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _cells(df: DataFrame, cell: int, box: tuple[str, str, str, str]) -> DataFrame:
    """A row for each grid cell that the half-open box touches: the equi-join key of a spatial join."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    last = lambda a, b: F.greatest(F.floor((b - 1) / cell), F.floor(a / cell)).cast("long")
    return df.withColumn("cx", F.explode(F.sequence(F.floor(x0 / cell).cast("long"), last(x0, x1)))).withColumn("cy", F.explode(F.sequence(F.floor(y0 / cell).cast("long"), last(y0, y1))))


def overlaps(left: DataFrame, right: DataFrame, cell: int) -> DataFrame:
    """Pairs with overlapping boxes in one sample; ``right``'s box is rx0, ry0, rx1, ry1. Both sides are dealt to grid cells, and a pair counts in the cell of its overlap's corner, so it comes once."""
    a = _cells(left, cell, ("x0", "y0", "x1", "y1"))
    b = _cells(right, cell, ("rx0", "ry0", "rx1", "ry1"))
    hit = a.join(b, ["sample_id", "cx", "cy"]).where("rx0 < x1 and rx1 > x0 and ry0 < y1 and ry1 > y0")
    corner = (F.floor(F.greatest("x0", "rx0") / cell) == F.col("cx")) & (F.floor(F.greatest("y0", "ry0") / cell) == F.col("cy"))
    return hit.where(corner).drop("cx", "cy")


def mask_stats(tiles: DataFrame, mask: DataFrame, cell: int = 512) -> DataFrame:
    """``tiles`` with mask_pixels and mask_ratio (of the tile's real area); blocks are disjoint."""
    blocks = mask.select("sample_id", *(F.col(c).cast("long").alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    part = (F.least("x1", "rx1") - F.greatest("x0", "rx0")) * (F.least("y1", "ry1") - F.greatest("y0", "ry0"))
    key = ["sample_id", "candidate_index"]
    sums = overlaps(tiles.select(*key, "x0", "y0", "x1", "y1"), blocks, cell).groupBy(key).agg(F.sum(part).alias("mask_pixels"))
    out = tiles.join(sums, key, "left").withColumn("mask_pixels", F.coalesce("mask_pixels", F.lit(0).cast("long")))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return out.withColumn("mask_ratio", F.when(size > 0, F.col("mask_pixels") / size).otherwise(0.0))


def audit(tiles: DataFrame, min_ratio: float, min_pixels: int, max_tiles: int = 0, fallback: bool = True) -> DataFrame:
    """``tiles`` with selected and reason. A tile passes by ratio or by pixels; if none of a sample does, all may stand in; of those
    that stand, the first max_tiles (0: all) by ratio, pixels and then candidate_index are selected."""
    w = Window.partitionBy("sample_id")
    passes = (F.col("mask_ratio") >= min_ratio) | (F.col("mask_pixels") >= min_pixels)
    t = tiles.withColumn("passes", passes).withColumn("any_passes", F.max("passes").over(w))
    stands = F.col("passes") | (~F.col("any_passes") & F.lit(fallback))
    order = w.orderBy(F.desc("stands"), F.desc("mask_ratio"), F.desc("mask_pixels"), "candidate_index")
    t = t.withColumn("stands", stands).withColumn("place", F.row_number().over(order))
    chosen = F.col("stands") & (F.lit(max_tiles <= 0) | (F.col("place") <= max_tiles))
    reason = F.when(chosen, "selected").when(~F.col("stands"), "below_mask_threshold").otherwise("truncated_by_max_tiles")
    return t.withColumn("selected", chosen).withColumn("reason", reason).drop("passes", "any_passes", "stands", "place")


def scan_order(tiles: DataFrame) -> DataFrame:
    """``tiles`` with tile_index and tile_count in raster order, and whether an earlier tile shares the row (has_left) or the column (has_top)."""
    w = Window.partitionBy("sample_id")
    before = lambda a, b: F.row_number().over(Window.partitionBy("sample_id", a).orderBy(b)) > 1
    return tiles.withColumn("tile_index", (F.row_number().over(w.orderBy("y0", "x0")) - 1).cast("long")).withColumn("tile_count", F.count("*").over(w)).withColumn("has_left", before("y0", "x0")).withColumn("has_top", before("x0", "y0"))


def state_regions(tiles: DataFrame, margin: int) -> DataFrame:
    """A row for each strip along a tile's left and top border that an earlier tile may have filled: strip 0 left, 1 top."""
    m = max(1, margin)
    strip = lambda i, x0, y0, x1, y1: F.struct(F.lit(i).alias("strip"), x0.alias("sx0"), y0.alias("sy0"), x1.alias("sx1"), y1.alias("sy1"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    both = F.array(F.when(F.col("has_left"), strip(0, x0, y0, F.least(x1, x0 + m), y1)), F.when(F.col("has_top"), strip(1, x0, y0, x1, F.least(y1, y0 + m))))
    return tiles.withColumn("s", F.explode(F.filter(both, lambda s: s.isNotNull()))).select("*", "s.*").drop("s")


def items(samples: DataFrame, tasks: DataFrame, tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Work items: sample x task x tile, without tasks for which the sample has no label."""
    work = labels.select("sample_id", "task").distinct().join(tasks, "task").join(samples, "sample_id")
    return work.join(tiles, "sample_id")


def features_in_tiles(tiles: DataFrame, features: DataFrame, cell: int = 512, key: list[str] | None = None) -> DataFrame:
    """Tile and feature pairs whose envelopes (rx0, ry0, rx1, ry1, closed) meet the half-open tile: low sides count, high sides do not."""
    f = features.withColumns({c: F.col(c).cast("double") for c in ("rx0", "ry0", "rx1", "ry1")})
    a = _cells(tiles, cell, ("x0", "y0", "x1", "y1"))
    # a closed envelope reaches the cell that its high corner lies in
    last = lambda c: F.floor(F.col(c) / cell).cast("long")
    b = f.withColumn("cx", F.explode(F.sequence(last("rx0"), last("rx1")))).withColumn("cy", F.explode(F.sequence(last("ry0"), last("ry1"))))
    hit = a.join(b, [*(key or ["sample_id"]), "cx", "cy"]).where("not (rx1 < x0 or rx0 >= x1 or ry1 < y0 or ry0 >= y1)")
    corner = (F.floor(F.greatest(F.col("x0").cast("double"), F.col("rx0")) / cell) == F.col("cx")) & (F.floor(F.greatest(F.col("y0").cast("double"), F.col("ry0")) / cell) == F.col("cy"))
    return hit.where(corner).drop("cx", "cy")


def without_empty(tiles: DataFrame, features: DataFrame, allow_empty: bool = False) -> DataFrame:
    """``tiles`` that some feature's envelope meets, or all."""
    if allow_empty:
        return tiles
    key = ["sample_id", "candidate_index"]
    return tiles.join(features_in_tiles(tiles, features).select(key).distinct(), key, "left_semi")


def for_stage(rasters: DataFrame, mask: DataFrame | None, tile: int, overlap: int, margin: int, min_ratio: float = 0.0, min_pixels: int = 0, max_tiles: int = 0, fallback: bool = True, search_box: bool = False, pad: int = 32, on: bool = True) -> DataFrame:
    """Selected tiles of a stage in scan order. Off, a raster is one tile. ``search_box`` looks only at the reviewed blocks' extent, padded (a raster without any is searched whole);
    without a mask (as when predicting) all tiles pass a ratio of 0."""
    if not on:
        return scan_order(whole(rasters))
    if search_box and mask is not None:
        box = mask_box(mask).select("sample_id", *(F.col(c).cast("long").alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
        rows = rasters.join(box, "sample_id", "left")
        region = expand_box([F.col(f"b{c}") for c in ("x0", "y0", "x1", "y1")], pad, F.col("width").cast("long"), F.col("height").cast("long"))
        made = generate(rows.withColumns({f"s{i}": c for i, c in enumerate(region)}), tile, overlap, margin, [f"s{i}" for i in range(4)])
    else:
        made = generate(rasters, tile, overlap, margin)
    measured = mask_stats(made, mask) if mask is not None else made.withColumns({"mask_pixels": F.lit(0).cast("long"), "mask_ratio": F.lit(0.0)})
    return scan_order(audit(measured, min_ratio, min_pixels, max_tiles, fallback).where("selected"))
