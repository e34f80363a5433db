"""Features made ready for tiles: reviewed parts, clipped to tiles and to their state strips, resampled, capped and sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import lines as L
from ..functions import polygons
from . import pieces
from .tiles import features_in_tiles

TILE = ["sample_id", "tile_index"]
BOX = ["x0", "y0", "x1", "y1"]
STRIP = ["sx0", "sy0", "sx1", "sy1"]
_RINGS = "array<array<struct<x:double,y:double>>>"


def _then(*places: str) -> Column:
    """The order so far with further places behind it."""
    return F.concat("order", F.array(*(F.col(p).cast("long") for p in places)))


def ranked(features: DataFrame, least: int, line: str = "line") -> DataFrame:
    """Features (sample_id, feature_id, props, line) with enough points, and ``order``: their place among the sample's by the sort key."""
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(L.sort_key(F.col(line), F.col("props")), "feature_id"))
    return features.where(F.size(line) >= least).withColumn("order", F.array(rank.cast("long")))


def trusted(rows: DataFrame, hits: DataFrame, least: int) -> DataFrame:
    """Lines cut into their runs of reviewed vertices (``hits``: sample_id, feature_id, pt, inside)."""
    runs = pieces.trusted_runs(hits, ["sample_id", "feature_id"], least).drop("n_points")
    cut = rows.drop("cut_start", "cut_end").join(runs, ["sample_id", "feature_id"])
    part = F.slice("line", (F.col("first_pt") + 1).cast("int"), (F.col("last_pt") - F.col("first_pt") + 1).cast("int"))
    return cut.withColumn("line", part).withColumn("order", _then("first_pt")).drop("first_pt", "last_pt")


def _near(rows: DataFrame, vertices: Column, tiles: DataFrame) -> DataFrame:
    """Rows beside the tiles (sample_id, tile_index, x0 ... y1) that their envelope meets."""
    e = rows.withColumn("e", L.envelope(vertices)).select("*", *(F.col(f"e.{c}").alias(f"r{c}") for c in BOX)).drop("e")
    return features_in_tiles(tiles.select(*TILE, *BOX), e).drop(*(f"r{c}" for c in BOX))


def _in_strips(rows: DataFrame, vertices: Column, strips: DataFrame) -> DataFrame:
    """Rows beside the strips of their tile that their envelope meets."""
    both = rows.join(strips.select(*TILE, "strip", *(F.col(c).cast("double").alias(c) for c in STRIP)), TILE)
    return both.where(L.envelope_hits(L.envelope(vertices), *(F.col(c) for c in STRIP))).withColumn("order", _then("strip"))


def _clipped(rows: DataFrame, box: list[str], least: int) -> DataFrame:
    return pieces.clipped(rows, [F.col(c).cast("double") for c in box], least).withColumn("order", _then("piece")).drop("piece", *box)


def _finished(rows: DataFrame, most: int, keep: list[str]) -> DataFrame:
    """The first ``most`` (0: all) rows of each tile in the order that they came about, with ``place`` by the sort key."""
    tile = Window.partitionBy(*TILE)
    if most > 0:
        rows = rows.withColumn("_n", F.row_number().over(tile.orderBy("order"))).where(F.col("_n") <= most).drop("_n")
    place = F.row_number().over(tile.orderBy(L.sort_key(F.col("line"), F.col("props")), "order")) - 1
    return rows.withColumn("place", place.cast("long")).select(*TILE, "feature_id", "place", "props", "line", *keep)


def spaced(line: Column, interval: float | None, closed: bool = False) -> Column:
    """Resampled every ``interval`` pixels, to at most twice as many points (and four); as it is without an interval."""
    return line if interval is None else L.resample(line, interval, F.greatest(F.lit(4), F.size(line) * 2), closed)


def lines(features: DataFrame, tiles: DataFrame, least: int = 2, interval: float | None = None, most: int = 0, hits: DataFrame | None = None, strips: DataFrame | None = None) -> DataFrame:
    """sample_id, tile_index, feature_id, place, props, line, cut_start, cut_end, clipped of line features in tiles.
    In this order: sorted; cut to reviewed runs (with ``hits``); clipped to the tile; clipped to each of its strips (with ``strips``; a piece in both comes twice); resampled; those with too few points go; capped; sorted."""
    rows = ranked(features.select("sample_id", "feature_id", "props", "line", F.lit(False).alias("cut_start"), F.lit(False).alias("cut_end")), least)
    if hits is not None:
        rows = trusted(rows, hits, least)
    rows = _clipped(_near(rows, F.col("line"), tiles), BOX, least)
    return _lines_done(rows, least, interval, most, strips)


def _lines_done(rows: DataFrame, least: int, interval: float | None, most: int, strips: DataFrame | None) -> DataFrame:
    if strips is not None:
        rows = _clipped(_in_strips(rows, F.col("line"), strips), STRIP, least)
    rows = rows.withColumn("line", spaced(F.col("line"), interval)).where(F.size("line") >= least)
    return _finished(rows.withColumn("clipped", F.col("cut_start") | F.col("cut_end")), most, ["cut_start", "cut_end", "clipped"])


def rings_equal(a: Column, b: Column) -> Column:
    """As many rings of as many points, each point close to its fellow."""
    near = lambda p, q: C.allclose(p["x"], q["x"]) & C.allclose(p["y"], q["y"])
    ring = lambda r, s: F.when(F.size(r) == F.size(s), F.forall(F.zip_with(r, s, near), lambda x: x)).otherwise(False)
    return F.when(F.size(a) == F.size(b), F.forall(F.zip_with(a, b, ring), lambda x: x)).otherwise(False)


def _cut_rings(rows: DataFrame, box: list[str], least: int) -> DataFrame:
    """One row a piece of each polygon inside its box; ``clipped`` where the piece is not the whole polygon."""
    parts = rows.withColumn("parts", polygons.clip_column(F.col("rings"), [F.col(c) for c in box])).select("*", F.posexplode("parts").alias("piece", "new")).drop("parts")
    cut = parts.where(F.size(F.col("new")[0]) >= least)
    cut = cut.withColumn("clipped", F.col("clipped") | ~rings_equal(F.col("rings"), F.col("new")))
    return cut.withColumn("rings", F.col("new")).withColumn("order", _then("piece")).drop("piece", "new", *box)


def areas(features: DataFrame, tiles: DataFrame, least: int = 3, interval: float | None = None, most: int = 0, ratios: DataFrame | None = None, strips: DataFrame | None = None) -> DataFrame:
    """sample_id, tile_index, feature_id, place, props, line (the outer ring), rings, clipped of polygons (sample_id, feature_id, props, rings) in tiles, in the steps of ``lines``;
    ``ratios`` (sample_id, feature_id, ok, partial): polygons that are not ok by the review mask go, partial ones count as clipped."""
    rows = ranked(features.select("sample_id", "feature_id", "props", "rings", F.col("rings")[0].alias("line")), least).withColumn("clipped", F.lit(False))
    if ratios is not None:
        rows = rows.join(ratios.where("ok").select("sample_id", "feature_id", "partial"), ["sample_id", "feature_id"]).withColumn("clipped", F.col("partial")).drop("partial")
    return _areas_done(_cut_rings(_near(rows, F.col("line"), tiles), BOX, least), least, interval, most, strips)


def _areas_done(rows: DataFrame, least: int, interval: float | None, most: int, strips: DataFrame | None) -> DataFrame:
    if strips is not None:
        rows = _cut_rings(_in_strips(rows, F.col("rings")[0], strips), STRIP, least).withColumn("clipped", F.lit(True))
    whole = F.filter(F.transform("rings", lambda r: spaced(r, interval, True)), lambda r: F.size(r) >= least)
    rows = rows.withColumn("first", F.size(spaced(F.col("rings")[0], interval, True))).withColumn("rings", whole).where(F.col("first") >= least)
    return _finished(rows.withColumn("line", F.col("rings")[0]), most, ["rings", "clipped"])


def state(memory: DataFrame, strips: DataFrame, least: int = 2, interval: float | None = None, most: int = 0) -> DataFrame:
    """What a tile is told of its predecessors: memory rows of a tile (sample_id, tile_index, place, props, line, rings for polygons, and the tile's x0 ... y1), oldest first, clipped to the tile and then to its strips.
    Tiles without strips are told nothing."""
    rows = memory.where(F.size("line") >= least).withColumn("order", F.array(F.col("place").cast("long"))).withColumn("feature_id", F.col("place"))
    if "rings" in memory.columns:
        rows = rows.withColumn("clipped", F.lit(False)).select(*TILE, "feature_id", "props", "line", "rings", "clipped", "order", *BOX)
        return _areas_done(_cut_rings(rows, BOX, least), least, interval, most, strips).drop("clipped")
    flags = rows.withColumn("cut_start", F.lit(False)).withColumn("cut_end", F.lit(False))
    return _lines_done(_clipped(flags.select(*TILE, "feature_id", "props", "line", "cut_start", "cut_end", "order", *BOX), BOX, least), least, interval, most, strips).drop("cut_start", "cut_end", "clipped")


def ring_targets(features: DataFrame, size: int) -> DataFrame:
    """Target items of polygons in uv: rings rotated to begin at their least vertex; clipped ones are cut inside, in and out."""
    cut = F.when(F.col("clipped"), "internal").otherwise("none")
    out = features.withColumn("rings", F.transform("rings", L.canonical_ring)).withColumn("line", F.col("rings")[0])
    return out.withColumn("cut_in", cut).withColumn("cut_out", cut).withColumn("source", F.lit("local"))


def from_uv(items: DataFrame, box: str = "box") -> DataFrame:
    """Items in uv (props, line, rings where there are) as pixel features, by each row's letterbox; properties are read leniently."""
    from ..functions.props import parse_relaxed_udf

    back = lambda p: L.point(*C.from_uv(p["x"], p["y"], F.col(box)))
    out = items.withColumn("line", F.transform("line", back)).withColumn("props", parse_relaxed_udf("props"))
    return out.withColumn("rings", F.transform("rings", lambda r: F.transform(r, back))) if "rings" in items.columns else out


def to_world(features: DataFrame, rasters: DataFrame, least: int = 2, size=None) -> DataFrame:
    """Pixel features (sample_id, line, rings where there are) in their raster's coordinates (a, c, e, f). Lines with too few points, and points that are no finite number, are no geometry and go.
    ``size``: a measure of the pixel features by the raster's scales (a, e), to be kept as ``size``; world coordinates are large, so what is measured in them differs in its last digits from place to place."""
    affine = [F.col("a"), F.lit(0.0), F.col("c"), F.lit(0.0), F.col("e"), F.col("f")]
    move = lambda p: L.point(*C.pixel_to_world(p["x"], p["y"], affine))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sound = (F.size("line") >= least) & F.forall("line", lambda p: finite(p["x"]) & finite(p["y"]))
    rows = features.where(sound).join(rasters.select("sample_id", "a", "c", "e", "f"), "sample_id")
    rows = (rows if size is None else rows.withColumn("size", size(F.col("a"), F.col("e")))).withColumn("line", F.transform("line", move))
    if "rings" in features.columns:
        rows = rows.withColumn("rings", F.transform("rings", lambda r: F.transform(r, move)))
    return rows.drop("a", "c", "e", "f")
