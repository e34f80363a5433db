"""Tile-by-tile merging of predictions in scan order, as a batch job and as a stream.

A line extends the first feature with like properties that an end of it meets within the tolerance, else it is a new one. An end of a feature is always an end of one of its lines, so lines that merge
are connected by ends that meet, and only within such a component does the order of tiles matter. Most components are plain: no end meets two others, nothing closes, properties are the same. There a line with one
earlier neighbour belongs to it, a line without any founds a feature, and a line between two earlier ones closes the gap towards the older feature, where nothing follows it; so features are runs of lines, and places in
them come from ranking lists by pointer jumping. Other components are folded line by line, each as it streams through a task. Samples are never gathered.

A feature is kept as its parts: for each line, whose feature it is in, at what place, and whether it is turned. What a feature was when a tile began are its parts from before.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import props as P
from ..operators.components import components
from ..operators.rounds import Steps
from ..operators.tiles import features_in_tiles

TOLERANCE = 3.0
BOX = ("x0", "y0", "x1", "y1")


def _bucket(properties: dict) -> str:
    """Equal for properties that are alike: their names, and the values that cannot be alike to another kind's (texts that are no number, and null)."""
    plain = lambda v: v is None or (isinstance(v, str) and math.isnan(P._number(v)))
    return json.dumps([[k, properties[k]] if plain(properties[k]) else [k] for k in sorted(properties)])


_bucket_udf = P._mapped(lambda t: _bucket(json.loads(t)))


class Ends:
    """The ends of what has been merged so far, found by their properties' bucket and the grid cells round them, so a line meets only what lies near its own ends."""

    def __init__(self, tolerance: float = TOLERANCE):
        self.tolerance = tolerance
        self.features: list[tuple[dict, tuple, tuple]] = []  # properties, first and last point
        self.places: list[list[int]] = []  # least and greatest place
        self.ends: dict[tuple, set[int]] = defaultdict(set)

    def _cells(self, properties: dict, *points: tuple) -> list[tuple]:
        size, name = max(self.tolerance, 1e-9), _bucket(properties)
        return [(name, math.floor(x / size), math.floor(y / size)) for x, y in points if math.isfinite(x) and math.isfinite(y)]

    def _meeting(self, properties: dict, first: tuple, last: tuple) -> tuple[int, bool, bool] | None:
        """The oldest feature that an end meets: its number, whether at its end, and whether the line must be turned to go on from there."""
        near = {n for name, x, y in self._cells(properties, first, last) for i in (-1, 0, 1) for j in (-1, 0, 1) for n in self.ends.get((name, x + i, y + j), ())}
        for n in sorted(near):
            known, begin, end = self.features[n]
            if not P.equal(known, properties):
                continue
            # at the feature's end first; there the line's own way round first, at the beginning turned first
            ways = [(math.dist(end if at_end else begin, last if turned else first), at_end, turned) for at_end, turned in ((True, False), (True, True), (False, True), (False, False))]
            gap, at_end, turned = min(ways, key=lambda w: w[0])
            if gap <= self.tolerance:
                return n, at_end, turned
        return None

    def add(self, properties: dict, first: tuple | None, last: tuple | None) -> tuple[int, int, bool]:
        """Number of the feature that a line goes to, its place there, and whether its points are turned round. Without ends (a line of one point) it joins nothing."""
        met = None if first is None else self._meeting(properties, first, last)
        if met is None:
            self.features.append((properties, first, last))
            self.places.append([0, 0])
            self._enter(len(self.features) - 1)
            return len(self.features) - 1, 0, False
        n, at_end, turned = met
        known, begin, end = self.features[n]
        for cell in self._cells(known, begin, end):
            self.ends[cell].discard(n)
        far = first if turned else last
        self.features[n] = (known, begin, far) if at_end else (known, far, end)
        self.places[n][at_end] += 1 if at_end else -1
        self._enter(n)
        return n, self.places[n][at_end], turned == at_end

    def _enter(self, n: int) -> None:
        properties, first, last = self.features[n]
        for cell in self._cells(properties, *(() if first is None else (first, last))):
            self.ends[cell].add(n)


def kept(features: DataFrame) -> DataFrame:
    """Predictions (line, or rings where there are) whose mean vertex lies in their tile's half-open keep box (keep_x0 ... keep_y1); a tile without a box keeps all."""
    vertices = F.coalesce(F.flatten("rings"), F.col("line")) if "rings" in features.columns else F.col("line")
    return features.where(F.col("keep_x0").isNull() | L.inside(L.center(vertices), F.col("keep_x0"), F.col("keep_y0"), F.col("keep_x1"), F.col("keep_y1")))


def _contacts(rows: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """key, a, sa, b, sb, d: ends (0 first, 1 last) of two lines of one bucket that lie within the tolerance; a comes before b."""
    size = max(tolerance, 1e-9)
    end = lambda i, p: F.struct(F.lit(i).alias("side"), p["x"].alias("x"), p["y"].alias("y"))
    ends = rows.where(F.size("line") >= 2).select(*key, "id", "bucket", F.explode(F.array(end(0, F.col("line")[0]), end(1, F.element_at("line", -1)))).alias("p")).select(*key, "id", "bucket", "p.*")
    cell = lambda c, d=0: F.floor(F.col(c) / size).cast("long") + d
    one = ends.select(*key, "bucket", F.col("id").alias("b"), F.col("side").alias("sb"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    nine = ends.select(*key, "bucket", F.col("id").alias("a"), F.col("side").alias("sa"), "x", "y", F.explode(F.sequence(cell("x", -1), cell("x", 1))).alias("cx")).withColumn("cy", F.explode(F.sequence(cell("y", -1), cell("y", 1))))
    gap = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)
    # what rounding might move over the border counts as a contact here and is judged by the fold
    return nine.join(one, [*key, "bucket", "cx", "cy"]).where("a < b").withColumn("d", gap).where(F.col("d") <= tolerance * (1 + 1e-9)).select(*key, "a", "sa", "b", "sb", "d")


def _ordered(key: list[str], tolerance: float):
    """Places of lines that stream by in the order of component and tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends, founders = None, Ends(tolerance), []
        for batch in batches:
            out = {"founder": [], "at": [], "flip": []}
            for r in batch.to_pylist():
                group = (*(r[k] for k in key), *r["label"].values())
                if group != at:
                    at, ends, founders = group, Ends(tolerance), []
                n, place, flip = ends.add(json.loads(r["props"]), *((v["x"], v["y"]) for v in (r["first"], r["last"])))
                if n == len(founders):
                    founders.append(r["id"])
                out["founder"].append(founders[n])
                out["at"].append(place)
                out["flip"].append(flip)
            columns = [*(batch[c] for c in (*key, "id")), pa.array(out["founder"], batch["id"].type), pa.array(out["at"], pa.int64()), pa.array(out["flip"], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*key, "id", "founder", "at", "flip"])

    return run


def _runs(lines: DataFrame, contacts: DataFrame, key: list[str], steps: Steps) -> DataFrame:
    """key, id, founder, at, flip of lines (key, id) in plain components, by their contacts."""
    earlier = contacts.select(*key, F.col("b").alias("id"), F.col("a").alias("ptr"), F.col("sb").alias("own"), F.col("sa").alias("side"))
    many = earlier.groupBy(*key, "id").agg(F.count("*").alias("n"))
    counted = steps.kept(earlier.join(many, [*key, "id"]), "earlier")
    # lines with one earlier neighbour: pointers to it, doubled until all point to founders
    now, n = steps.kept(counted.where("n = 1").select(*key, "id", "ptr", "own", "side", F.lit(1).cast("long").alias("dist")), "jump-0"), 0
    while True:
        ahead = now.select(*key, F.col("id").alias("ptr"), F.col("ptr").alias("further"), F.col("side").alias("there"), F.col("dist").alias("more"))
        n += 1
        new = steps.kept(now.join(ahead, [*key, "ptr"], "left").select(*key, "id", F.coalesce("further", "ptr").alias("ptr"), "own", F.coalesce("there", "side").alias("side"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("further").isNotNull().alias("moved")), f"jump-{n}")
        steps.drop(f"jump-{n - 1}")
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    # lines between two earlier ones: to the older feature, one place behind the neighbour in it
    ahead = now.select(*key, F.col("id").alias("ptr"), F.col("ptr").alias("further"), F.col("side").alias("there"), F.col("dist").alias("more"))
    ways = counted.where("n = 2").join(ahead, [*key, "ptr"], "left").select(*key, "id", F.struct(F.coalesce("further", "ptr").alias("ptr"), "own", F.coalesce("there", "side").alias("side"), (1 + F.coalesce("more", F.lit(0))).cast("long").alias("dist")).alias("way"))
    between = ways.groupBy(*key, "id").agg(F.min("way").alias("way")).select(*key, "id", "way.*")
    at = F.when(F.col("side") == 1, F.col("dist")).otherwise(-F.col("dist"))
    linked = now.unionByName(between).select(*key, "id", F.col("ptr").alias("founder"), at.alias("at"), (F.col("own") == F.col("side")).alias("flip"))
    first = lines.join(many, [*key, "id"], "left_anti")
    return linked.unionByName(first.select(*key, "id", F.col("id").alias("founder"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("flip")))


def parts(rows: DataFrame, key: list[str], tolerance: float, steps: Steps) -> DataFrame:
    """key, id, founder, at, flip of lines (key, id, props, bucket, line); ids are in the order of merging."""
    alone = lambda df: df.select(*key, "id", F.col("id").alias("founder"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("flip"))
    contacts = steps.kept(_contacts(rows, key, tolerance), "contacts")
    if contacts.isEmpty():
        return alone(rows)
    label = steps.kept(components(contacts.select(*key, "a", "b"), key, steps), "labels")
    steps_of = lambda df, c: df.join(label.withColumnRenamed("id", c), [*key, c])
    ends = contacts.select(*key, F.col("a").alias("id"), F.col("sa").alias("side"), "d").unionByName(contacts.select(*key, F.col("b").alias("id"), F.col("sb").alias("side"), "d"))
    busy = steps_of(ends.groupBy(*key, "id", "side").agg(F.count("*").alias("n"), F.max("d").alias("d")), "id").groupBy(*key, "label").agg(F.max("n").alias("most"), F.max("d").alias("far"))
    links = steps_of(contacts.withColumnRenamed("a", "id"), "id").groupBy(*key, "label").agg(F.count("*").alias("links"))
    own = rows.select(*key, "id", "props").join(label, [*key, "id"]).groupBy(*key, "label").agg(F.count("*").alias("lines"), ((F.min("props") == F.max("props")) & ~F.bool_or(F.col("props").rlike("NaN|Infinity"))).alias("same"))
    plain = busy.join(links, [*key, "label"]).join(own, [*key, "label"]).select(*key, "label", ((F.col("most") == 1) & (F.col("links") < F.col("lines")) & F.col("same") & (F.col("far") <= tolerance * (1 - 1e-9))).alias("plain"))
    judged = steps.kept(label.join(plain, [*key, "label"]), "judged")
    runs = _runs(judged.where("plain").select(*key, "id"), contacts.join(judged.where("plain").select(*key, F.col("id").alias("a")), [*key, "a"], "left_semi"), key, steps)
    mixed = rows.join(judged.where("not plain"), [*key, "id"]).select(*key, "label", "id", "props", F.col("line")[0].alias("first"), F.element_at("line", -1).alias("last"))
    fold = mixed.repartition(*key, "label").sortWithinPartitions(*key, "label", "id").mapInArrow(_ordered(key, tolerance), runs.schema)
    return runs.unionByName(fold).unionByName(alone(rows.join(judged.select(*key, "id"), [*key, "id"], "left_anti")))


def numbered(rows: DataFrame, key: list[str], tile: str, then: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their number within the key by tile and then by other columns: numbers within a tile, behind the numbers of all earlier tiles."""
    size = rows.groupBy(*key, tile).agg(F.count("*").alias("_n"))
    before = size.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*key, tile).orderBy(*then)))
    return own.join(before, [*key, tile]).withColumn(name, (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_before", "_own")


def _joined(pieces: DataFrame, by: list[str]) -> DataFrame:
    """by, props, line, n_parts of features from their parts (by, at, flip, props, line)."""
    turned = F.when(F.col("flip"), F.reverse("line")).otherwise(F.col("line"))
    fewer = F.greatest(F.size("line") - 1, F.lit(0))
    own = F.when(F.col("at") == 0, turned).when(F.col("at") > 0, F.slice(turned, F.lit(2), fewer)).otherwise(F.slice(turned, F.lit(1), fewer))  # the joint's own vertex goes
    out = pieces.select(*by, "at", own.alias("own"), F.when(F.col("at") == 0, F.col("props")).alias("props"))
    out = out.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "own"))).alias("all"), F.max("props").alias("props"), F.count("*").alias("n_parts"))
    return out.select(*by, "props", F.flatten(F.transform("all", lambda x: x["own"])).alias("line"), "n_parts")


def fold(features: DataFrame, key: list[str], tolerance: float = TOLERANCE, joins: bool = True, tiles: DataFrame | None = None) -> DataFrame:
    """key, tile_index, place, props, line (and rings, where ``features`` has them), n_parts of the features (key, tile_index, feature_id, props, line) merged in the order of tiles. Rows with a null tile_index are the final features.
    ``tiles`` (key, tile_index, x0, y0, x1, y1) asks for memory as it is when a tile begins, too: rows with the tile's index, of features whose envelope meets its box. Without ``joins``, as for polygons, every feature is new."""
    steps = Steps(features.sparkSession)
    rings = ["rings"] if "rings" in features.columns else []
    rows = features.select(*key, F.struct(F.col("tile_index").cast("long").alias("tile"), F.col("feature_id").alias("feature")).alias("id"), P.canonical_udf(F.coalesce("props", F.lit("{}"))).alias("props"), "line", *rings)
    rows = steps.kept(rows.withColumn("bucket", _bucket_udf("props")) if joins else rows, "rows")
    found = parts(rows, key, tolerance, steps) if joins else rows.select(*key, "id", F.col("id").alias("founder"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("flip"))
    place = numbered(found.where("at = 0").select(*key, "founder", F.col("founder.tile").alias("_tile")), key, "_tile", ["founder.feature"]).drop("_tile")
    found = steps.kept(found.join(place, [*key, "founder"]).join(rows.select(*key, "id", "props", "line", *rings), [*key, "id"]), "parts")
    by = [*key, "place"]
    joined = lambda df, by: df.where("at = 0").select(*by, "props", "line", *rings, F.lit(1).cast("long").alias("n_parts")) if not joins else _joined(df, by)
    final = joined(found, by).select(*key, F.lit(None).cast("long").alias("tile_index"), "place", "props", "line", *rings, "n_parts")
    if tiles is None:
        return final
    # features that may meet a tile's box, as they were when it began
    e = L.envelope(F.col("line"))
    shapes = final.where(F.size("line") > 0).select(*key, "place", *(e[c].alias(f"r{c}") for c in BOX)).join(found.where("at = 0").select(*by, F.col("id.tile").alias("_since")), by)
    met = features_in_tiles(tiles.select(*key, "tile_index", *BOX), shapes, key=key).where("_since < tile_index").select(*key, "tile_index", "place", *(F.col(c).alias(f"_{c}") for c in BOX))
    seen = joined(met.join(found, by).where("id.tile < tile_index"), [*key, "tile_index", "place", *(f"_{c}" for c in BOX)])
    e = L.envelope(F.col("line"))
    seen = seen.where(L.envelope_hits(e, *(F.col(f"_{c}").cast("double") for c in BOX)))
    return final.unionByName(seen.select(*key, F.col("tile_index").cast("long").alias("tile_index"), "place", "props", "line", *rings, "n_parts"))


def merge_tiles(rows: DataFrame, key: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """key, props, line, n_points, n_parts of merged lines. ``rows``: key, tile_index, feature_id, props, line and the tile's keep box; features whose
    mean vertex lies outside the keep box go first."""
    merged = fold(kept(rows), key, tolerance)
    return merged.select(*key, "props", "line", F.size("line").cast("long").alias("n_points"), "n_parts")
