"""Polylines and rings as ``array<struct<x: double, y: double>>`` columns, by higher-order functions only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Order of boundary sides in canonical forms.
SIDES = ("left", "top", "right", "bottom")
RANK = {"left": 0, "top": 1, "none": 2, "right": 3, "bottom": 4}


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once a row: higher-order functions do not share common parts on their own."""
    return F.transform(F.array(value), use)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def points(order: Column, x: Column, y: Column) -> Column:
    """Aggregate: points in the order of a column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.cast("double").alias("x"), y.cast("double").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def segments(line: Column) -> Column:
    """Structs a, b of neighbouring points."""
    n = F.size(line)
    return F.when(n < 2, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(
        F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda s, g: s + distance(g["a"], g["b"]))


def scaled_length(line: Column, sx: Column, sy: Column) -> Column:
    """Length after both axes are scaled. Only differences of points count, so a line and its copy elsewhere, whose differences are the same numbers, are equally long to the last digit."""
    side = lambda g, f, by: by * (g["a"][f] - g["b"][f])
    return F.aggregate(segments(line), F.lit(0.0), lambda s, g: s + F.sqrt(side(g, "x", sx) * side(g, "x", sx) + side(g, "y", sy) * side(g, "y", sy)))


def area(ring: Column) -> Column:
    """Of an open ring, by the shoelace rule about its first point, so it is exact far from the origin, too."""
    moved = F.transform(ring, lambda p: F.struct((p["x"] - ring[0]["x"]).alias("x"), (p["y"] - ring[0]["y"]).alias("y")))
    closed = F.concat(moved, F.slice(moved, 1, 1))
    return F.abs(F.aggregate(segments(closed), F.lit(0.0), lambda s, g: s + g["a"]["x"] * g["b"]["y"] - g["b"]["x"] * g["a"]["y"])) / 2


def envelope(line: Column) -> Column:
    low = lambda f: F.array_min(F.transform(line, lambda p: p[f]))
    high = lambda f: F.array_max(F.transform(line, lambda p: p[f]))
    return F.struct(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))


def center(line: Column) -> Column:
    """Mean of the vertices."""
    mean = lambda f: F.aggregate(line, F.lit(0.0), lambda s, p: s + p[f]) / F.size(line)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def envelope_hits(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Touching the low sides counts, touching the high ones does not."""
    return ~((e["x1"] < x0) | (e["x0"] >= x1) | (e["y1"] < y0) | (e["y0"] >= y1))


def inside(p: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (p["x"] >= x0) & (p["x"] < x1) & (p["y"] >= y0) & (p["y"] < y1)


def any_inside(line: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.exists(line, lambda p: inside(p, x0, y0, x1, y1))


def boundary_side(p: Column, size: Column | int, tolerance: float = 1.5) -> Column:
    """The nearest side of the square within the tolerance; ties go left, top, right, bottom; else none."""
    edge = (F.lit(size) if isinstance(size, int) else size) - 1

    def nearest(q: Column) -> Column:
        gaps = zip(SIDES, (F.abs(q["x"]), F.abs(q["y"]), F.abs(edge - q["x"]), F.abs(edge - q["y"])), strict=True)
        return F.array_min(F.array(*(F.struct(x.alias("d"), F.lit(i).alias("o"), F.lit(s).alias("s")) for i, (s, x) in enumerate(gaps))))

    return let(let(p, nearest), lambda m: F.when(m["d"] <= tolerance, m["s"]).otherwise("none"))


def boundary_sides(line: Column, size: Column | int, tolerance: float = 1.5) -> Column:
    """Sides that vertices touch, each once, by first touch."""
    return F.array_distinct(F.filter(F.transform(line, lambda p: boundary_side(p, size, tolerance)), lambda s: s != "none"))


def _rank(side: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair))[side]


def canonical_line(line: Column, size: Column | int) -> Column:
    """Reversed if its end comes before its start by (side, x, y)."""
    key = lambda p: F.struct(_rank(boundary_side(p, size)).alias("r"), p["x"].alias("x"), p["y"].alias("y"))
    return let(line, lambda pts: F.when(key(F.element_at(pts, -1)) < key(pts[0]), F.reverse(pts)).otherwise(pts))


def canonical_line_lex(line: Column) -> Column:
    """Reversed if its end comes before its start by (y, x)."""
    key = lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))
    return let(line, lambda pts: F.when(key(F.element_at(pts, -1)) < key(pts[0]), F.reverse(pts)).otherwise(pts))


def canonical_ring(ring: Column) -> Column:
    """Rotated to begin at the least (x, y, place); the sense stays."""
    least = F.array_min(F.transform(ring, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), i.alias("i"))))["i"]
    return F.when(F.size(ring) == 0, ring).otherwise(F.concat(F.slice(ring, least + 1, F.size(ring)), F.slice(ring, F.lit(1), least)))


def anchors(line: Column, most: int) -> Column:
    """Up to ``most`` (two at least) points at evenly spaced, truncated places."""
    k = max(2, most)
    n = F.size(line)
    place = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int"))
    return F.when(n <= k, line).otherwise(F.transform(place, lambda i: line[i]))


def resample(line: Column, interval: Column | float, most: Column | int, closed: bool = False) -> Column:
    """Evenly spaced points along a line, both ends among them, or around a ring. The spacing is the total over the number of steps, not ``interval``;
    corners do not survive. A line without length gives its first point."""
    most = F.lit(most) if isinstance(most, int) else most
    base = line
    if closed:
        same = (line[0]["x"] == F.element_at(line, -1)["x"]) & (line[0]["y"] == F.element_at(line, -1)["y"])
        base = F.when((F.size(line) > 1) & same, F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(1)))).otherwise(line)
        base = F.concat(base, F.slice(base, 1, 1))
    step = F.greatest(F.lit(interval) if isinstance(interval, float | int) else interval, F.lit(1e-3))
    # running lengths: struct of the sum and the list so far
    zero = F.struct(F.lit(0.0).alias("s"), F.array(F.lit(0.0)).alias("l"))

    def grown(a: Column, g: Column) -> Column:
        return let(a["s"] + distance(g["a"], g["b"]), lambda s: F.struct(s.alias("s"), F.concat(a["l"], F.array(s)).alias("l")))

    def spread(v: Column) -> Column:
        base, total, at = v["base"], v["cum"]["s"], v["cum"]["l"]
        n = F.least(F.greatest(F.floor(total / step) + 1, F.lit(3 if closed else 2)), F.greatest(most, F.lit(3 if closed else 2))).cast("int")

        def place(t: Column) -> Column:
            k = F.least(F.greatest(F.size(F.filter(at, lambda c: c <= t)), F.lit(1)), F.size(base) - 1)

            def between(k: Column) -> Column:
                a, b = base[k - 1], base[k]
                span = at[k] - at[k - 1]
                r = F.when(span > 0, (t - at[k - 1]) / span).otherwise(0.0)
                return let(r, lambda r: point(a["x"] + (b["x"] - a["x"]) * r, a["y"] + (b["y"] - a["y"]) * r))

            return let(k, between)

        out = let(n, lambda n: F.transform(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == n - 1, total).otherwise(i * (total / (n - 1)))), place))
        if closed:
            out = F.slice(out, F.lit(1), F.size(out) - 1)
        return F.when((F.size(line) <= 1) | (total < 1e-6), F.slice(line, 1, 1)).otherwise(out)

    return let(let(base, lambda b: F.struct(b.alias("base"), F.aggregate(segments(b), zero, grown).alias("cum"))), spread)


#: Vertex and segment pairs that the distance kernel holds at once.
_COMBINATIONS = 1_000_000


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points of an Arrow array of lines: x, y, where each line's begin, and how many it has (a null line none)."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    points = column.flatten()
    x, y = (np.asarray(points.field(i), np.float64) for i in (0, 1))
    return x, y, np.cumsum(size) - size, size


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each of the sizes."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _furthest(a: tuple, b: tuple) -> np.ndarray:
    """For each pair of lines, the greatest distance of a vertex of the first to the second's segments."""
    (ax, ay, a0, na), (bx, by, b0, nb) = a, b
    pair = np.repeat(np.arange(len(na)), na)
    at, parts = ranges(a0, na), nb[pair] - 1
    near = np.empty(len(at))
    ends = np.cumsum(parts)
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _COMBINATIONS, "right")))
        n = parts[low:high]
        g = ranges(b0[pair[low:high]], n)
        px, py = np.repeat(ax[at[low:high]], n), np.repeat(ay[at[low:high]], n)
        dx, dy = bx[g + 1] - bx[g], by[g + 1] - by[g]
        sq = dx * dx + dy * dy
        t = np.clip(((px - bx[g]) * dx + (py - by[g]) * dy) / np.where(sq > 0, sq, 1), 0, 1)
        gap = np.hypot(bx[g] + t * dx - px, by[g] + t * dy - py)
        near[low:high] = np.minimum.reduceat(gap, np.cumsum(n) - n)
        low = high
    return np.maximum.reduceat(near, np.cumsum(na) - na) if len(near) else near


def hausdorff_of(a: pa.Array, b: pa.Array) -> pa.Array:
    """Greatest distance of a vertex of either line to the other line; null if a line has fewer than two points."""
    a, b = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b))
    one, two = flat(a), flat(b)
    ok = (one[3] >= 2) & (two[3] >= 2)
    x, y = ((v[0], v[1], v[2][ok], v[3][ok]) for v in (one, two))
    out = np.zeros(len(ok))
    out[ok] = np.maximum(_furthest(x, y), _furthest(y, x)) if ok.any() else 0
    return pa.array(out, pa.float64(), mask=~ok)


@F.arrow_udf(DoubleType())
def _hausdorff(a: pa.Array, b: pa.Array) -> pa.Array:
    return hausdorff_of(a, b)


def hausdorff(a: Column, b: Column) -> Column:
    """Greatest distance of a vertex of either line to the other line, by one NumPy pass over a batch of pairs."""
    return _hausdorff(a, b)


def endpoint_error(a: Column, b: Column) -> Column:
    """Mean distance of the ends, for the better of both senses; infinite for empty lines."""
    end = lambda c: F.element_at(c, -1)
    ahead = (distance(a[0], b[0]) + distance(end(a), end(b))) / 2
    back = (distance(a[0], end(b)) + distance(end(a), b[0])) / 2
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(float("inf"))).otherwise(F.least(ahead, back))


def sort_key(line: Column, props: Column) -> Column:
    """(first y, first x, last y, last x, number, properties); empty lines come last."""
    far = F.lit(1e9)
    get = lambda p, f: F.coalesce(p[f], far)
    first, last = F.get(line, F.lit(0)), F.try_element_at(line, F.lit(-1))
    return F.struct(get(first, "y").alias("a"), get(first, "x").alias("b"), get(last, "y").alias("c"), get(last, "x").alias("d"), F.size(line).alias("n"), props.alias("p"))
