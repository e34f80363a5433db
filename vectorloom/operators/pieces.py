"""Features against review masks and boxes: inside ratios, runs of trusted vertices, clipped pieces and their cut flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import polygons


def vertex_hits(points: DataFrame, mask: DataFrame, cell: int = 64) -> DataFrame:
    """``points`` (sample_id, px, py, ...) with inside: whether the vertex, rounded half-even and clamped to the raster's width and height, lies in a reviewed block."""
    cx = F.least(F.greatest(F.rint(F.col("px").cast("double")), F.lit(0.0)), F.col("width") - 1.0).cast("long")
    cy = F.least(F.greatest(F.rint(F.col("py").cast("double")), F.lit(0.0)), F.col("height") - 1.0).cast("long")
    p = points.withColumn("mx", cx).withColumn("my", cy).withColumn("gx", F.floor(F.col("mx") / cell)).withColumn("gy", F.floor(F.col("my") / cell))
    to = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
    m = mask.select("sample_id", *(F.col(c).cast("long").alias(f"r{c}") for c in ("x0", "y0", "x1", "y1"))).withColumn("gx", to("rx0", "rx1")).withColumn("gy", to("ry0", "ry1"))
    # blocks are disjoint, so a vertex meets one at most
    hit = p.join(m, (p.sample_id == m.sample_id) & (p.gx == m.gx) & (p.gy == m.gy) & (p.mx >= m.rx0) & (p.mx < m.rx1) & (p.my >= m.ry0) & (p.my < m.ry1), "left")
    return hit.select(*(p[c] for c in points.columns), p.mx, p.my, m.rx0.isNotNull().alias("inside"))


def inside_ratio(hits: DataFrame, key: list[str], least: float = 0.5) -> DataFrame:
    """key, n_points, n_inside, ratio, ok (ratio reaches ``least``) and partial (ratio under 0.999)."""
    out = hits.groupBy(key).agg(F.count("*").alias("n_points"), F.count_if("inside").alias("n_inside"))
    ratio = F.col("n_inside") / F.col("n_points")
    return out.withColumn("ratio", ratio).withColumn("ok", ratio >= least).withColumn("partial", ratio < 0.999)


def trusted_runs(hits: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """Gaps and islands: maximal runs of inside vertices of at least ``least`` points, with first_pt, last_pt, n_points, cut_start and cut_end."""
    w = Window.partitionBy(*key)
    p = hits.withColumn("i", F.row_number().over(w.orderBy("pt")) - 1).withColumn("n", F.count("*").over(w))
    p = p.where("inside").withColumn("run", F.col("i") - F.row_number().over(w.orderBy("pt")))
    runs = p.groupBy(*key, "run").agg(F.min("i").alias("first_pt"), F.max("i").alias("last_pt"), F.count("*").alias("n_points"), F.max("n").alias("n"))
    return runs.where(F.col("n_points") >= least).select(*key, F.col("first_pt").cast("long").alias("first_pt"), F.col("last_pt").cast("long").alias("last_pt"), "n_points", (F.col("first_pt") > 0).alias("cut_start"), (F.col("last_pt") < F.col("n") - 1).alias("cut_end"))


def cut_flags(source: Column, piece: Column, cut_start: Column, cut_end: Column) -> tuple[Column, Column]:
    """A piece is cut where its end moved away from the source's, or where the source was cut."""
    moved = lambda a, b: ~(_close(a["x"], b["x"]) & _close(a["y"], b["y"]))
    return cut_start | moved(piece[0], source[0]), cut_end | moved(F.element_at(piece, -1), F.element_at(source, -1))


def _close(a: Column, b: Column) -> Column:
    from ..functions.coords import allclose

    return allclose(a, b)


def clip_segments(line: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Liang-Barsky: for each segment that has length inside the closed box, a struct of i, t0, t1, a and b."""
    far = F.lit(float("inf"))

    def one(g: Column, i: Column) -> Column:
        dx, dy = g["b"]["x"] - g["a"]["x"], g["b"]["y"] - g["a"]["y"]
        t0, t1 = F.lit(0.0), F.lit(1.0)
        for p, q in ((-dx, g["a"]["x"] - x0), (dx, x1 - g["a"]["x"]), (-dy, g["a"]["y"] - y0), (dy, y1 - g["a"]["y"])):
            r = q / F.when(p != 0, p)
            t0 = F.greatest(t0, F.when(p < 0, r).when((p == 0) & (q < 0), far).otherwise(0.0))
            t1 = F.least(t1, F.when(p > 0, r).otherwise(1.0))
        at = lambda t: L.point(g["a"]["x"] + t * dx, g["a"]["y"] + t * dy)
        return F.struct(i.alias("i"), t0.alias("t0"), t1.alias("t1"), F.when(t0 == 0, g["a"]).otherwise(at(t0)).alias("a"), F.when(t1 == 1, g["b"]).otherwise(at(t1)).alias("b"))

    return F.filter(F.transform(L.segments(line), one), lambda s: s["t0"] < s["t1"])


def clip_line(line: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Pieces of a line in a closed box, in order: an array of lines. A single touched point is no piece. A line that crosses itself is to be split there before (``polygons.noded``)."""
    parts = clip_segments(line, x0, y0, x1, y1)
    empty = F.array().cast("array<array<struct<x:double,y:double>>>")

    def add(acc: Column, s: Column) -> Column:
        goes_on = (F.size(acc["p"]) > 0) & (acc["i"] == s["i"] - 1) & (acc["t"] == 1.0) & (s["t0"] == 0.0)
        head = F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0)))
        longer = F.concat(head, F.array(F.concat(F.try_element_at(acc["p"], F.lit(-1)), F.array(s["b"]))))
        new = F.concat(acc["p"], F.array(F.array(s["a"], s["b"])))
        return F.struct(F.when(goes_on, longer).otherwise(new).alias("p"), s["i"].alias("i"), s["t1"].alias("t"))

    start = F.struct(empty.alias("p"), F.lit(-2).alias("i"), F.lit(0.0).alias("t"))
    return F.aggregate(parts, start, add)["p"]


def clipped(features: DataFrame, box: list[Column], least: int = 2) -> DataFrame:
    """One row a piece: ``features`` (line, cut_start, cut_end), split where they cross themselves and clipped to the box, with piece number and new cut flags; pieces under ``least`` points go."""
    parts = features.withColumn("_parts", polygons.noded(F.col("line")))
    pieces = F.flatten(F.transform("_parts", lambda p: clip_line(p, *box)))
    rows = parts.select(*features.columns, F.posexplode(pieces).alias("piece", "part")).where(F.size("part") >= least)
    s, e = cut_flags(F.col("line"), F.col("part"), F.col("cut_start"), F.col("cut_end"))
    return rows.withColumn("new_start", s).withColumn("new_end", e).drop("line", "cut_start", "cut_end").withColumnsRenamed({"part": "line", "new_start": "cut_start", "new_end": "cut_end"})


def capped(pieces: DataFrame, key: list[str], most: int) -> DataFrame:
    """The first ``most`` (0: all) pieces of each key in the order of their raw features, before any final sort."""
    if most <= 0:
        return pieces
    w = Window.partitionBy(*key).orderBy("raw_key", "raw_index", "piece", "strip")
    return pieces.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def keep_centered(features: DataFrame, box: list[Column]) -> DataFrame:
    """Features (line) whose mean vertex lies in the half-open box."""
    return features.where(L.inside(L.center(F.col("line")), *box))


def targets(features: DataFrame, size: int) -> DataFrame:
    """Target items of line features in uv: canonical line, cut_in, cut_out and source."""
    # the flags belong to the first and last place of the feature, whichever way its points run
    named = lambda side, cut: F.when(side != "none", side).when(cut, "internal").otherwise("none")
    side = lambda p, cut: L.let(L.boundary_side(p, size), lambda s: named(s, cut))
    ends = L.let(L.canonical_line(F.col("line"), size), lambda pts: F.struct(pts.alias("line"), side(pts[0], F.col("cut_start")).alias("cut_in"), side(F.element_at(pts, -1), F.col("cut_end")).alias("cut_out")))
    out = features.withColumn("_target", ends).drop("line").select("*", "_target.line", "_target.cut_in", "_target.cut_out").drop("_target")
    return out.withColumn("source", F.when(F.col("cut_in").isin("left", "top"), "state").otherwise("local"))


def state_items(features: DataFrame, size: int, most: int) -> DataFrame:
    """One anchor row for each of a feature's touched left and top sides: side and sampled line."""
    sides = F.filter(L.boundary_sides(F.col("line"), size), lambda s: s.isin("left", "top"))
    return features.withColumn("side", F.explode(sides)).withColumn("line", L.let(L.canonical_line(F.col("line"), size), lambda pts: L.anchors(pts, most)))
