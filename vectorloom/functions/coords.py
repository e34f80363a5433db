"""Coordinate spaces: geographic (lon, lat), world (metres), pixel, model uv and coordinate bins.

Columns in, columns out, so every conversion stays inside code generation. Half-even rounding is ``rint``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lines import let

# Fixed values of the WGS 84 ellipsoid and of the transverse Mercator grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING, FALSE_NORTHING_SOUTH = 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the fourth order.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))

CRS84 = "urn:ogc:def:crs:OGC:1.3:CRS84"
GEOGRAPHIC = ("EPSG:4326", CRS84, "OGC:CRS84", "CRS84")


def utm_zone(crs: str) -> tuple[int, bool] | None:
    """Zone and whether it is north of the equator; None for geographic systems."""
    name = crs.strip().upper()
    if name in {c.upper() for c in GEOGRAPHIC}:
        return None
    if name.startswith("EPSG:32") and name[5:].isdigit() and len(name) == 10 and name[7] in "67" and 1 <= int(name[8:]) <= 60:
        return int(name[8:]), name[7] == "6"
    raise ValueError(f"unsupported coordinate system: {crs}")


def zone_of(crs: Column) -> Column:
    """``utm_zone`` row by row: struct zone (0: geographic) and north; a name that is not supported is an error, null stays null."""
    name = F.upper(F.trim(crs))
    number = F.substring(name, 9, 2).try_cast("int")
    grid = name.rlike("^EPSG:32[67][0-9]{2}$") & number.between(1, 60)
    system = lambda zone, north: F.struct(zone.cast("int").alias("zone"), north.alias("north"))
    wrong = F.raise_error(F.concat(F.lit("unsupported coordinate system: "), crs)).cast("struct<zone:int,north:boolean>")
    return F.when(crs.isNull(), F.lit(None)).when(name.isin(*(c.upper() for c in GEOGRAPHIC)), system(F.lit(0), F.lit(True))).when(grid, system(number, F.substring(name, 8, 1) == "6")).otherwise(wrong)


def _to_utm(lon: Column, lat: Column, zone: Column, north: Column) -> Column:
    """Struct x, y of easting and northing. Parts that are used more than once are named, so an expression stays as long as the formula."""

    def grid(q: Column) -> Column:
        xi, eta = q["xi"], q["eta"]
        x, y = eta, xi
        for j, a in enumerate(_ALPHA, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct((FALSE_EASTING + SCALE * _A * x).alias("x"), (F.when(north, 0.0).otherwise(FALSE_NORTHING_SOUTH) + SCALE * _A * y).alias("y"))

    sphere = lambda v: F.struct(F.atan2(v["t"], F.cos(v["l"])).alias("xi"), F.atanh(F.sin(v["l"]) / F.sqrt(1 + v["t"] * v["t"])).alias("eta"))
    conformal = lambda v: F.struct(F.sinh(F.atanh(v["s"]) - F.lit(_E) * F.atanh(F.lit(_E) * v["s"])).alias("t"), v["l"].alias("l"))
    first = F.struct(F.sin(F.radians(lat)).alias("s"), F.radians(lon - (6 * zone - 183)).alias("l"))
    return let(first, lambda a: let(conformal(a), lambda b: let(sphere(b), grid)))


def _from_utm(east: Column, northing: Column, zone: Column, north: Column) -> Column:
    """Struct x, y of longitude and latitude."""
    n = _N
    # the conformal latitude's series
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)

    def sphere(q: Column) -> Column:
        x, e = q["xi"], q["eta"]
        for j, b in enumerate(_BETA, 1):
            x = x - b * F.sin(2 * j * q["xi"]) * F.cosh(2 * j * q["eta"])
            e = e - b * F.cos(2 * j * q["xi"]) * F.sinh(2 * j * q["eta"])
        return F.struct(x.alias("x"), e.alias("e"))

    def place(v: Column) -> Column:
        phi = v["chi"]
        for j, d in enumerate(delta, 1):
            phi = phi + d * F.sin(2 * j * v["chi"])
        return F.struct((F.degrees(F.atan2(F.sinh(v["e"]), F.cos(v["x"]))) + (6 * zone - 183)).alias("x"), F.degrees(phi).alias("y"))

    chi = lambda v: F.struct(F.asin(F.sin(v["x"]) / F.cosh(v["e"])).alias("chi"), v["x"].alias("x"), v["e"].alias("e"))
    first = F.struct(((northing - F.when(north, 0.0).otherwise(FALSE_NORTHING_SOUTH)) / (SCALE * _A)).alias("xi"), ((east - FALSE_EASTING) / (SCALE * _A)).alias("eta"))
    return let(first, lambda a: let(sphere(a), lambda b: let(chi(b), place)))


def projected(x: Column, y: Column, source: Column | str, target: Column | str) -> Column:
    """Struct x, y from one supported system to another, x (lon) before y (lat). A system is a name, or a column of names where it differs from row to row."""
    here = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    start = F.struct(x.alias("x"), y.alias("y"))
    if isinstance(source, str) and isinstance(target, str):
        a, b = ((F.lit(z[0]), F.lit(z[1])) if z else None for z in (utm_zone(source), utm_zone(target)))
        if utm_zone(source) == utm_zone(target):
            return here({"x": x, "y": y})
        ground = here({"x": x, "y": y}) if a is None else _from_utm(x, y, *a)
        return ground if b is None else let(ground, lambda p: _to_utm(p["x"], p["y"], *b))
    zone = lambda crs: zone_of(F.lit(crs) if isinstance(crs, str) else crs)

    def moved(v: Column) -> Column:
        p, a, b = v["p"], v["a"], v["b"]
        ground = F.when(a["zone"] == 0, here(p)).otherwise(_from_utm(p["x"], p["y"], a["zone"], a["north"]))
        return F.when(a == b, here(p)).otherwise(let(ground, lambda g: F.when(b["zone"] == 0, g).otherwise(_to_utm(g["x"], g["y"], b["zone"], b["north"]))))

    return let(F.struct(start.alias("p"), zone(source).alias("a"), zone(target).alias("b")), moved)


def project(x: Column, y: Column, source: Column | str, target: Column | str) -> tuple[Column, Column]:
    """``projected`` as two columns."""
    p = projected(x, y, source, target)
    return p["x"], p["y"]


def pixel_to_world(x: Column, y: Column, t: list[Column]) -> tuple[Column, Column]:
    """Affine (a, b, c, d, e, f): X = a x + b y + c, Y = d x + e y + f."""
    a, b, c, d, e, f = t
    return a * x + b * y + c, d * x + e * y + f


def world_to_pixel(x: Column, y: Column, t: list[Column]) -> tuple[Column, Column]:
    a, b, c, d, e, f = t
    det = a * e - b * d
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def letterbox(width: Column, height: Column, target: Column, crop: list[Column] | None = None) -> Column:
    """How a crop (x0, y0, x1, y1; default: all) fits a square of ``target``: struct of crop_x, crop_y, crop_w, crop_h, resized_w, resized_h, pad_x, pad_y, scale_x, scale_y."""
    x0, y0, x1, y1 = crop or [F.lit(0), F.lit(0), width, height]
    w, h = F.greatest(F.lit(1), x1 - x0), F.greatest(F.lit(1), y1 - y0)
    scale = F.least(target / w, target / h)
    rw = F.greatest(F.lit(1), F.rint(w * scale).cast("int"))
    rh = F.greatest(F.lit(1), F.rint(h * scale).cast("int"))
    return F.struct(x0.alias("crop_x"), y0.alias("crop_y"), w.alias("crop_w"), h.alias("crop_h"), rw.alias("resized_w"), rh.alias("resized_h"), F.floor((target - rw) / 2).cast("int").alias("pad_x"), F.floor((target - rh) / 2).cast("int").alias("pad_y"), (rw / w).alias("scale_x"), (rh / h).alias("scale_y"))


def to_uv(x: Column, y: Column, box: Column) -> tuple[Column, Column]:
    return (x - box["crop_x"]) * box["scale_x"] + box["pad_x"], (y - box["crop_y"]) * box["scale_y"] + box["pad_y"]


def from_uv(u: Column, v: Column, box: Column) -> tuple[Column, Column]:
    tiny = F.lit(1e-6)
    return (u - box["pad_x"]) / F.greatest(box["scale_x"], tiny) + box["crop_x"], (v - box["pad_y"]) / F.greatest(box["scale_y"], tiny) + box["crop_y"]


def clamp(x: Column, size: Column | int) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(size) - 1 if isinstance(size, int) else size - 1)


def quantise(u: Column, size: int, bins: int) -> Column:
    return F.rint(clamp(u, size) / (size - 1) * (bins - 1)).cast("int")


def dequantise(q: Column, size: int, bins: int) -> Column:
    return q / (bins - 1) * (size - 1)


def allclose(a: Column, b: Column, atol: float = 1e-3, rtol: float = 1e-5) -> Column:
    """|a - b| <= atol + rtol |b|: the tolerance grows with b."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def float32(x: Column) -> Column:
    """Rounds to single precision, to reproduce artifacts that were written so."""
    return x.cast("float").cast("double")
