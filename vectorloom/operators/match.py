"""Pairs of features, greedy one-to-one matching and removal of near-duplicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import polygons
from ..functions.lines import ranges
from . import grid
from .components import components
from .rounds import Steps


def line_pairs(left: DataFrame, right: DataFrame, key: list[str], threshold: float, names: tuple[str, str] = ("pred", "gt")) -> DataFrame:
    """key, left and right id, distance and endpoint_error of pairs of lines (id, line) at most ``threshold`` apart.
    The envelopes of lines that close have sides within the threshold of one another. So the right side is dealt to the ``grid`` cell of its envelope's least corner, the left side to the cells
    within the threshold of its own, and a pair meets in one cell at most."""
    a, b = names
    side = lambda df, n: df.where(F.size("line") >= 2).select(*key, F.col("id").alias(n), F.col("line").alias(f"{n}_line"), L.envelope(F.col("line")).alias(f"{n}_e"))
    corner = lambda n, d: [F.col(f"{n}_e.x0") + d, F.col(f"{n}_e.y0") + d]
    near = " and ".join(f"abs({a}_e.{c} - {b}_e.{c}) <= {threshold}" for c in ("x0", "y0", "x1", "y1"))
    reach = [*corner(a, -threshold), *corner(a, threshold)]
    close = grid.met(side(left, a), side(right, b), key, reach, corner(b, 0.0) * 2, max(64.0, 4 * threshold), finest=max(2 * threshold, 1e-9)).where(near)
    pairs = close.withColumn("distance", L.hausdorff(F.col(f"{a}_line"), F.col(f"{b}_line"))).where(F.col("distance") <= threshold)
    return pairs.select(*key, a, b, "distance", L.endpoint_error(F.col(f"{a}_line"), F.col(f"{b}_line")).alias("endpoint_error"))


def box_pairs(left: DataFrame, right: DataFrame, key: list[str], threshold: float, names: tuple[str, str] = ("pred", "gt"), cell: int = 256, most: int = grid.MOST, carry: list[str] | None = None) -> DataFrame:
    """key, left and right id and iou of axis-parallel boxes (id, x0, y0, x1, y1) that overlap with at least ``threshold`` (over 0). They meet in the cells of a ``grid``. ``carry``: corners to keep, as pred_x0, gt_x0 ..., so that no later step joins the pairs to get them."""
    a, b = names
    corners = ("x0", "y0", "x1", "y1")
    side = lambda df, n: df.select(*key, F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in corners))
    # half-open boxes of whole numbers: the last cell is that of the last pixel
    box = lambda n: [F.col(f"{n}_x0"), F.col(f"{n}_y0"), F.col(f"{n}_x1") - 1, F.col(f"{n}_y1") - 1]
    p = grid.met(side(left, a), side(right, b), key, box(a), box(b), cell, most)
    low = lambda c: F.greatest(f"{a}_{c}", f"{b}_{c}")
    w, h = F.least(f"{a}_x1", f"{b}_x1") - low("x0"), F.least(f"{a}_y1", f"{b}_y1") - low("y0")
    size = lambda n: (F.col(f"{n}_x1") - F.col(f"{n}_x0")) * (F.col(f"{n}_y1") - F.col(f"{n}_y0"))
    p = p.withColumn("inter", F.when((w > 0) & (h > 0), w * h).otherwise(0))
    return p.select(*key, a, b, (F.col("inter") / (size(a) + size(b) - F.col("inter"))).alias("iou"), *(carry or [])).where(F.col("iou") >= threshold)


#: Likenesses from which on pairs of boxes are matched, one after the other.
TIERS = (0.98, 0.95, 0.9, 0.8, 0.65, 0.5)
POLYGON_TIERS = (0.9, 0.75, 0.6, 0.45)


def alike_boxes(left: DataFrame, right: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """``box_pairs`` for high thresholds. Corners and extents of boxes that are so alike lie within a share of the left one's extent of one another, so boxes meet in cells of corner and extent; where many boxes overlap, few are alike."""
    share = (1 - threshold) / threshold + 1e-9
    wide = right.agg(F.avg(F.col("x1") - F.col("x0")).alias("w"), F.avg(F.col("y1") - F.col("y0")).alias("h")).first()
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sides = [(F.col("x0"), w, max(1.0, 4 * share * (wide["w"] or 1))), (F.col("y0"), h, max(1.0, 4 * share * (wide["h"] or 1)))]
    corners = ("x0", "y0", "x1", "y1")
    dealt = lambda df, n: df.select(*key, F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in corners), *(f"_{k}" for k in range(4)))
    a, b = left, right
    for k, (at, extent, cell) in enumerate(sides):
        for j, v in enumerate((at, extent)):
            a = a.withColumn(f"_{2 * k + j}", F.explode(F.sequence(F.floor((v - share * extent) / cell), F.floor((v + share * extent) / cell))))
            b = b.withColumn(f"_{2 * k + j}", F.floor(v / cell))
    p = dealt(a, "pred").join(dealt(b, "gt"), [*key, *(f"_{k}" for k in range(4))])
    low, high = (lambda c: F.greatest(f"pred_{c}", f"gt_{c}")), (lambda c: F.least(f"pred_{c}", f"gt_{c}"))
    pw, ph = high("x1") - low("x0"), high("y1") - low("y0")
    size = lambda n: (F.col(f"{n}_x1") - F.col(f"{n}_x0")) * (F.col(f"{n}_y1") - F.col(f"{n}_y0"))
    p = p.withColumn("inter", F.when((pw > 0) & (ph > 0), pw * ph).otherwise(0))
    return p.select(*key, "pred", "gt", (F.col("inter") / (size("pred") + size("gt") - F.col("inter"))).alias("iou")).where(F.col("iou") >= threshold)


def _tiered(pred: DataFrame, gt: DataFrame, key: list[str], threshold: float, digits: int, tiers: tuple[float, ...], alike, last) -> DataFrame:
    """``greedy`` over all pairs by iou (rounded to ``digits``), descending: those that ``alike`` finds in one tier after the other, then those that ``last`` finds among what these leave free."""
    steps = Steps(pred.sparkSession)
    free, taken = {"pred": pred, "gt": gt}, None
    for n, tier in enumerate([*(t for t in tiers if t > threshold), threshold]):
        pairs = last(free["pred"], free["gt"], key, tier) if tier == threshold else alike(free["pred"], free["gt"], key, tier - 10.0**-digits).where(F.round("iou", digits) >= tier)
        taken = steps.append(greedy(pairs, key, [-F.round("iou", digits)], carry=["iou"]), "taken")
        if tier != threshold:
            old = free
            free = {s: steps.kept(df.join(taken.select(*key, F.col(s).alias("id")), [*key, "id"], "left_anti"), f"{s}-{n}") for s, df in old.items()}
            steps.drop(*(f"{s}-{n - 1}" for s in free))
    return taken


def greedy_boxes(pred: DataFrame, gt: DataFrame, key: list[str], threshold: float, digits: int = 9) -> DataFrame:
    """``greedy`` over all ``box_pairs`` by iou (rounded to ``digits``), descending, without a table of all pairs: the most alike ones are matched first, and only boxes that they leave free are paired from the next lower likeness on."""
    return _tiered(pred, gt, key, threshold, digits, TIERS, alike_boxes, box_pairs)


def greedy_polygons(pred: DataFrame, gt: DataFrame, key: list[str], threshold: float, cell: float = 256.0, digits: int = 9) -> DataFrame:
    """``greedy_boxes`` for polygons (id, rings), over ``polygon_pairs``."""
    pairs = lambda p, g, k, t: polygon_pairs(p, g, k, t, cell=cell)
    return _tiered(pred, gt, key, threshold, digits, POLYGON_TIERS, pairs, pairs)


def ring_area(rings: Column) -> Column:
    """Area of a polygon: its outer ring's without its holes'."""
    areas = F.transform(rings, L.area)
    return F.element_at(areas, 1) - F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0))), F.lit(0.0), lambda s, x: s + x)


def _sided(df: DataFrame, key: list[str], *extra: Column) -> DataFrame:
    return df.where(F.size("rings") >= 1).select(*key, "id", "rings", polygons.measures(F.col("rings")).alias("e"), *extra)


def _reach(e: str, threshold: float) -> list[Column]:
    """The envelope cut down to where the centre of what a polygon shares with a match may lie."""
    out = []
    for c in ("x", "y"):
        low, high, at = F.col(f"{e}.{c}0"), F.col(f"{e}.{c}1"), F.col(f"{e}.c{c}")
        reach = (1 - threshold + 1e-6) * (high - low) + 1e-6
        out.append((F.coalesce(F.greatest(low, at - reach), low), F.coalesce(F.least(high, at + reach), high)))
    return [out[0][0], out[1][0], out[0][1], out[1][1]]


class _Polygons:
    """Polygons of a cell by columns: where they reach, envelopes, areas and centres, and the numbers of rings."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        number = lambda c: np.asarray(rows[c].combine_chunks().cast(pa.float64()).fill_null(math.nan), np.float64)
        self.box = [number(f"_b{k}") for k in range(4)]
        self.e = {c: number(f"_e_{c}") for c in ("x0", "y0", "x1", "y1", "size", "cx", "cy")}
        self.rings = number("_n")
        self.profile = rows["_p"].combine_chunks()
        self.plain = self.profile.is_valid().to_numpy(zero_copy_only=False)
        self.place = np.cumsum(self.plain) - 1

    def profiles(self, origin: tuple[float, float]) -> polygons.Profiles:
        return polygons.Profiles(self.profile.drop_null(), origin)

    def outlines(self, at: np.ndarray) -> pa.Array:
        own = pa.array(at)
        return polygons.outlined(self.profile.take(own), self.rows["_r"].combine_chunks().take(own))


def _alike(p: _Polygons, q: _Polygons, side: float, cell: tuple[int, int], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and iou of pairs of polygons that overlap with at least ``threshold`` and belong to the cell: it holds the least corner of what both reach."""
    origin = (float(q.e["x0"][0]), float(q.e["y0"][0]))
    a_lines, b_lines = p.profiles(origin), q.profiles(origin)
    most = [float((q.box[k + 2] - q.box[k]).max()) for k in (0, 1)]
    cells = [max((float((p.box[k + 2] - p.box[k]).mean()) + most[k]) / fine, 1e-9) for k, fine in ((0, 8), (1, 4))]
    for a, b in _looked_up(q.box[:2], [p.box[k] - most[k] - 1e-9 for k in (0, 1)], p.box[2:], cells):
        for k, c in ((1, "y"), (0, "x")):
            low = np.maximum(p.box[k][a], q.box[k][b])
            wide = np.minimum(p.e[f"{c}1"][a], q.e[f"{c}1"][b]) - np.maximum(p.e[f"{c}0"][a], q.e[f"{c}0"][b])
            here = (low <= np.minimum(p.box[k + 2][a], q.box[k + 2][b])) & (wide > 0)
            here = np.flatnonzero(here & (np.floor(low / side) == cell[k]))
            a, b = a[here], b[here]
        wide = [np.minimum(p.e[f"{c}1"][a], q.e[f"{c}1"][b]) - np.maximum(p.e[f"{c}0"][a], q.e[f"{c}0"][b]) for c in ("x", "y")]
        less, more = np.minimum(p.e["size"][a], q.e["size"][b]), np.maximum(p.e["size"][a], q.e["size"][b])
        near = (wide[0] * wide[1] >= threshold * more - 1e-6) & ((p.rings[a] > 1) | (q.rings[b] > 1) | (less >= threshold * more - 1e-6))
        for c in ("x", "y"):
            reach = (1 - threshold + 1e-6) * (p.e[f"{c}1"][a] - p.e[f"{c}0"][a] + q.e[f"{c}1"][b] - q.e[f"{c}0"][b]) + 1e-6
            near &= ~(np.abs(p.e[f"c{c}"][a] - q.e[f"c{c}"][b]) > reach)
        a, b = a[near], b[near]
        iou = np.full(len(a), -1.0)
        both = p.plain[a] & q.plain[b]
        for of, step in ((np.flatnonzero(both), 4096), (np.flatnonzero(~both), 1024)):
            for at in (of[k : k + step] for k in range(0, len(of), step)):
                if step == 4096:
                    iou[at] = polygons.iou_by_profile(a_lines, b_lines, p.place[a[at]], q.place[b[at]], p.e["size"][p.plain], q.e["size"][q.plain])
                else:
                    iou[at] = polygons.iou_of(p.outlines(a[at]), q.outlines(b[at])).fill_null(-1.0).to_numpy(zero_copy_only=False)
        good = iou >= threshold
        yield a[good], b[good], iou[good]


def _paired(key: list[str], threshold: float, cell: float):
    """Pairs of polygons that stream by in the order of cell and side, the right side first, which is held."""
    of = [*key, "_level", "_fx", "_fy", "_side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, right = None, [], None
        for batch in batches:
            for begin, end in runs(batch, of):
                *place, side = batch.slice(begin, 1).select(of).to_pylist()[0].values()
                if place != at:
                    at, held, right = place, [], None
                rows = pa.Table.from_batches([batch.slice(begin, end - begin)])
                if side == 0:
                    held.append(rows)
                    continue
                if not held:
                    continue
                right = right or _Polygons(pa.concat_tables(held))
                level, *where = place[-3:]
                left = _Polygons(rows)
                for a, b, iou in _alike(left, right, cell / 2.0**level, where, threshold):
                    if len(a):
                        own, other = rows.take(pa.array(a)), right.rows["_id"].combine_chunks().take(pa.array(b))
                        yield pa.RecordBatch.from_arrays([*(own[c].combine_chunks() for c in (*key, "_id")), other, pa.array(iou)], [*key, "_a", "_b", "iou"])

    return run


def runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[int, int]]:
    """Where rows begin and end that agree in the columns."""
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows - 1, bool)
    for c in columns:
        new |= np.diff(batch[c].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)) != 0
    starts = [0, *(np.flatnonzero(new) + 1).tolist()]
    yield from zip(starts, [*starts[1:], batch.num_rows], strict=True)


def polygon_pairs(left: DataFrame, right: DataFrame, key: list[str], threshold: float, names: tuple[str, str] = ("pred", "gt"), cell: float = 256.0, most: int = grid.MOST, few: bool = False) -> DataFrame:
    """key, left and right id and iou of polygons (id, rings; the first ring is the outer one, the rest holes) that overlap with at least ``threshold`` (over 0).

    A polygon without holes shares at least the threshold of its area with its match, so its centre of mass lies within (1 - threshold) of its extent of the centre of what they share: envelopes cut down to that meet in the cells of a
    ``grid``, and the more alike pairs must be, the fewer meet. Envelopes' overlap bounds the intersection, the larger area the union, and the smaller area the intersection, so only pairs that these let through are measured.

    A cell's polygons come together in a task, its right side held there, and pairs are made there by portions: polygons travel once a cell, not once a pair. Polygons that any upright line cuts in one stretch (``polygons.Profiles``) are measured
    by that, others swept. ``few``: a key has few polygons, so pairs of many keys are made by a join and swept together."""
    a, b = names
    steps = Steps(left.sparkSession)
    if not few:
        known = F.lit(True)
        for k in key:
            known &= F.col(k).isNotNull()

        def side(df: DataFrame, n: str, number: int) -> DataFrame:
            rows = _sided(df.where(known), key, polygons.profiles(F.col("rings")).alias("p"))
            boxes = [c.alias(f"_b{k}") for k, c in enumerate(_reach("e", threshold))]
            e = [F.col(f"e.{c}").alias(f"_e_{c}") for c in ("x0", "y0", "x1", "y1", "size", "cx", "cy")]
            return steps.kept(rows.select(*key, F.lit(number).alias("_side"), F.col("id").alias("_id"), *boxes, *e, F.size("rings").alias("_n"), F.col("p").alias("_p"), F.when(F.col("p").isNull(), F.col("rings")).alias("_r")), n)

        sides = [side(left, a, 1), side(right, b, 0)]
        box = [F.col(f"_b{k}") for k in range(4)]
        split = grid.levels(sides[1], key, box, cell, most)
        rows = grid.dealt(sides[0], key, box, cell, split).unionByName(grid.dealt(sides[1], key, box, cell, split))
        of = [*key, "_level", "_fx", "_fy"]
        rows = rows.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *of).sortWithinPartitions(*of, "_side")
        schema = rows.select(*key, F.col("_id").alias("_a"), F.col("_id").alias("_b"), F.lit(0.0).alias("iou")).schema
        ids = [F.col(c).cast(df.schema["id"].dataType).alias(n) for c, df, n in (("_a", left, a), ("_b", right, b))]
        return rows.mapInArrow(_paired(key, threshold, cell), schema).select(*key, *ids, "iou")

    def alone(df: DataFrame, n: str) -> DataFrame:
        return steps.kept(_sided(df, key).select(*key, F.col("id").alias(n), F.col("rings").alias(f"{n}_rings"), F.col("e").alias(f"{n}_e")), n)

    met = grid.met(alone(left, a), alone(right, b), key, _reach(f"{a}_e", threshold), _reach(f"{b}_e", threshold), cell, most, tasks=True)
    wide = lambda lo, hi: F.least(f"{a}_e.{hi}", f"{b}_e.{hi}") - F.greatest(f"{a}_e.{lo}", f"{b}_e.{lo}")
    met = met.where((wide("x0", "x1") > 0) & (wide("y0", "y1") > 0))
    met = met.where(wide("x0", "x1") * wide("y0", "y1") >= threshold * F.greatest(f"{a}_e.size", f"{b}_e.size") - 1e-6)
    met = met.where((F.size(f"{a}_rings") > 1) | (F.size(f"{b}_rings") > 1) | (F.least(f"{a}_e.size", f"{b}_e.size") >= threshold * F.greatest(f"{a}_e.size", f"{b}_e.size") - 1e-6))
    centres = (F.abs(F.col(f"{a}_e.c{c}") - F.col(f"{b}_e.c{c}")) <= (1 - threshold + 1e-6) * sum((F.col(f"{n}_e.{c}1") - F.col(f"{n}_e.{c}0") for n in names), F.lit(0.0)) + 1e-6 for c in ("x", "y"))
    for near in centres:
        met = met.where(F.coalesce(near, F.lit(True)))
    return met.select(*key, a, b, polygons.iou_column(F.col(f"{a}_rings"), F.col(f"{b}_rings")).alias("iou")).where(F.col("iou") >= threshold)


def greedy(pairs: DataFrame, key: list[str], order: list[Column], names: tuple[str, str] = ("pred", "gt"), carry: list[str] | None = None) -> DataFrame:
    """One-to-one matches of each key: pairs in ascending ``order`` (then ids) are taken if neither side is taken yet.

    In rounds: a pair that comes first among those of both its sides is taken whatever the others are, for no earlier pair can
    take a side from it; pairs of taken sides go, and what is left is looked at again. Each side of each key is a group of its own, so work spreads by features, not by samples. Taken pairs add up in one table."""
    a, b = names
    carry = carry or []
    steps = Steps(pairs.sparkSession)
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(a), F.col(b))
    sides = [Window.partitionBy(*key, a), Window.partitionBy(*key, b)]
    taken = lambda df: df.withColumns({f"_least{i}": F.min("_rank").over(w) for i, w in enumerate(sides)}).withColumn("_taken", (F.col("_rank") == F.col("_least0")) & (F.col("_rank") == F.col("_least1"))).drop("_least0", "_least1")
    left = steps.kept(taken(pairs.select(*key, a, b, *carry, rank.alias("_rank"))), "round-0")
    n = 0
    while True:
        done = steps.append(left.where("_taken").select(*key, a, b, *carry), "taken")
        rest = left.withColumns({f"_gone{i}": F.max("_taken").over(w) for i, w in enumerate(sides)}).where("not _gone0 and not _gone1").drop("_gone0", "_gone1", "_taken")
        n += 1
        left = steps.kept(taken(rest), f"round-{n}")
        steps.drop(f"round-{n - 1}")
        if left.isEmpty():
            return done


#: Conflicts of one component up to which it is folded as a whole, within one task; larger ones go in rounds.
WHOLE = 20_000


def _folded(key: list[str]):
    """Ids that go, from conflicts in the order of component and leader: a leader that still stands takes its conflict's other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gone = None, set()
        for batch in batches:
            out = []
            of, lead, ids = ([tuple(r.values()) for r in batch.select([*key, "label"]).to_pylist()], *(batch[c].to_pylist() for c in ("lead", "id")))
            for i, (group, x, y) in enumerate(zip(of, lead, ids, strict=True)):
                if group != at:
                    at, gone = group, set()
                if x not in gone and y not in gone:
                    gone.add(y)
                    out.append(i)
            yield batch.select([*key, "id"]).take(pa.array(out, pa.int64()))

    return run


def suppress(features: DataFrame, conflicts: DataFrame, key: list[str], whole: int = WHOLE) -> DataFrame:
    """Greedy suppression: features (key, id, size) by size and then id, both descending, stay unless one that stays conflicts (key, a, b; either way round).

    Conflicts fall into connected components, which do not touch one another. Those of at most ``whole`` conflicts are folded one after the other as they stream through a task, sorted by leader. Larger ones go in rounds, each led by its first
    features: those that no conflict makes second stay, those that they lead go, and with these all conflicts that they take part in. Features without conflicts are never moved."""
    steps = Steps(features.sparkSession)
    place = F.struct(-F.col("size"), -F.col("id"))
    rank = features.select(*key, "id", place.alias("r"))
    side = lambda n: rank.select(*key, F.col("id").alias(n), F.col("r").alias(f"r{n}"))
    both = conflicts.select(*key, "a", "b").join(side("a"), [*key, "a"]).join(side("b"), [*key, "b"]).where("a <> b")
    first = F.col("ra") < F.col("rb")
    every = steps.kept(both.select(*key, F.when(first, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.least("ra", "rb").alias("r")).distinct(), "conflicts")
    kept = features.select(*key, "id")
    if every.isEmpty():
        return kept
    label = components(every.select(*key, F.col("lead").alias("a"), F.col("id").alias("b")), key, steps)
    named = every.join(label.withColumnRenamed("id", "lead"), [*key, "lead"])
    size = named.groupBy(*key, "label").agg(F.count("*").alias("n"))
    named = steps.kept(named.join(size, [*key, "label"]), "named")
    fold = named.where(F.col("n") <= whole).select(*key, "label", "r", "lead", "id").repartition(*key, "label").sortWithinPartitions(*key, "label", "r", "id")
    out = fold.select(*key, "label", "lead", "id").mapInArrow(_folded(key), fold.select(*key, "id").schema)
    gone = steps.append(out, "gone")
    left = steps.kept(named.where(F.col("n") > whole).select(*key, "lead", "id"), "round-0")
    n = 0
    while not left.isEmpty():
        led = left.select(*key, F.col("id").alias("lead")).distinct()
        out = steps.kept(left.join(led, [*key, "lead"], "left_anti").select(*key, "id").distinct(), f"out-{n}")
        gone = steps.append(out, "gone")
        n += 1
        left = steps.kept(left.join(out, [*key, "id"], "left_anti").join(out.withColumnRenamed("id", "lead"), [*key, "lead"], "left_anti"), f"round-{n}")
        steps.drop(f"round-{n - 1}", f"out-{n - 1}")
    return kept.join(gone, [*key, "id"], "left_anti")


CORNERS = ("x0", "y0", "x1", "y1")


def _far(threshold: float) -> float:
    """How far from a box's centre, as a share of its extent, the centre of a box may lie that overlaps with at least ``threshold``: both share that much of the wider one's extent."""
    return max(1 - threshold, (1 - threshold) / (2 * threshold))


def _looked_up(points: list[np.ndarray], low: list[np.ndarray], high: list[np.ndarray], cells: list[float], most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs (box, point) such that the point may lie in the box from ``low`` to ``high`` (x, y), in portions of about ``most``. Points are sorted by the row and column of a grid; further ones than those in a box come, too."""
    rows, spans = None, []
    for axis in (1, 0):
        least, far = points[axis].min(), points[axis].max()
        cell = max(cells[axis], (far - least) // 65536)
        place = ((points[axis] - least) // cell).astype(np.int64)
        count = int(place.max()) + 1
        spans.append((np.clip((low[axis] - least) // cell, 0, count).astype(np.int64), np.clip((high[axis] - least) // cell, -1, count - 1).astype(np.int64)))
        rows = place if rows is None else rows * count + place
    order = np.argsort(rows, kind="stable")
    rows, ((top, bottom), (left, right)) = rows[order], spans
    lines = np.where(left <= right, np.maximum(bottom - top + 1, 0), 0)
    of = np.repeat(np.arange(len(lines)), lines)
    row = ranges(top, lines) * count
    first = np.searchsorted(rows, row + left[of])
    n = np.searchsorted(rows, row + right[of], "right") - first
    ends, begin = np.cumsum(n), 0
    while begin < len(of):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        m = n[begin:stop]
        yield np.repeat(of[begin:stop], m), order[ranges(first[begin:stop], m)]
        begin = stop


def _conflicts(held: np.ndarray, asked: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs (asked, held) of boxes (x0, y0, x1, y1 by box) that overlap with at least ``threshold``, looked up by their centres."""
    if not held.shape[1] or not asked.shape[1]:
        return
    # twice the centres are whole numbers
    at, mid = [held[k] + held[k + 2] for k in (0, 1)], [asked[k] + asked[k + 2] for k in (0, 1)]
    reach = [np.ceil(np.maximum(2 * _far(threshold) * (1 + 1e-9) * (asked[k + 2] - asked[k]), 0)).astype(np.int64) + 1 for k in (0, 1)]
    cells = [max(1, int(r.mean()) // fine) for r, fine in zip(reach, (8, 2), strict=True)]
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    for a, b in _looked_up(at, [m - r for m, r in zip(mid, reach, strict=True)], [m + r for m, r in zip(mid, reach, strict=True)], cells):
        w = np.minimum(asked[2][a], held[2][b]) - np.maximum(asked[0][a], held[0][b])
        h = np.minimum(asked[3][a], held[3][b]) - np.maximum(asked[1][a], held[1][b])
        over = np.flatnonzero((w > 0) & (h > 0))
        a, b, inter = a[over], b[over], w[over] * h[over]
        alike = inter / (size(asked)[a] + size(held)[b] - inter) >= threshold
        yield a[alike], b[alike]


class _Held:
    """Boxes of a cell that stay, and those of which that is not known yet."""

    def __init__(self):
        self.sure = self.open = np.zeros((4, 0), np.int64)

    def told(self, box: np.ndarray, known: np.ndarray, inside: np.ndarray, threshold: float) -> np.ndarray:
        """Of each box, in the order of rank and after all those held: 0 if one that surely stays is before it, else 1 if it surely stays itself, else 2.
        Boxes come by size, so those that are too large for the first are too large for all that follow."""
        size = (box[2, 0] - box[0, 0]) * (box[3, 0] - box[1, 0])
        fits = lambda b: b[:, threshold * (1 - 1e-9) * (b[2] - b[0]) * (b[3] - b[1]) <= size]
        self.sure, self.open = fits(self.sure), fits(self.open)
        state = np.where(known | inside, 1, 2)
        ask = np.flatnonzero(~known)
        for a, _ in _conflicts(self.sure, box[:, ask], threshold):
            state[ask[a]] = 0
        ask = np.flatnonzero(~known & (state == 1))
        for a, _ in _conflicts(self.open, box[:, ask], threshold):
            state[ask[a]] = 2
        left = np.flatnonzero(state)
        # what is not inside stays open whatever other such boxes are
        ask = np.flatnonzero(~known[left])
        inner = left[inside[left] | known[left]]
        outer = left[~inside[left] & ~known[left]]
        pairs = [(left[ask][a], inner[b]) for a, b in _conflicts(box[:, inner], box[:, left[ask]], threshold)]
        pairs += [(inner[~known[inner]][a], outer[b]) for a, b in _conflicts(box[:, outer], box[:, inner[~known[inner]]], threshold)]
        if pairs:
            later, before = (np.concatenate(x) for x in zip(*pairs, strict=True))
            both = np.flatnonzero(before < later)
            both = both[np.argsort(later[both], kind="stable")]
            told = state.tolist()
            for j, i in zip(later[both].tolist(), before[both].tolist(), strict=True):
                if told[j] and told[i]:
                    told[j] = 0 if told[i] == 1 else 2
            state = np.array(told)
        self.sure, self.open = np.concatenate([self.sure, box[:, state == 1]], 1), np.concatenate([self.open, box[:, state == 2]], 1)
        return state


#: Boxes of a cell that are told at once.
PORTION = 4096


def _settled(key: list[str], threshold: float):
    """From boxes in the order of cell and rank: those whose home cell is this one and that do not go, and whether it is sure that they stay. A box goes if one that surely stays is before it; it stays if none is, none is open, and the cell shows
    all that could be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            cells = batch.select([*key, "_cx", "_cy"])
            box = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in CORNERS])
            sure, home, inside = (batch[c].to_numpy(zero_copy_only=False) for c in ("sure", "home", "inside"))
            state = np.zeros(batch.num_rows, np.int64)
            for begin, end in runs(batch, cells.schema.names):
                cell = tuple(cells.slice(begin, 1).to_pylist()[0].values())
                if cell != at:
                    at, held = cell, _Held()
                for low in range(begin, end, PORTION):
                    part = slice(low, min(end, low + PORTION))
                    state[part] = held.told(box[:, part], sure[part], inside[part], threshold)
            out = np.flatnonzero(home & (state > 0))
            yield pa.RecordBatch.from_arrays([*batch.select([*key, "id", *CORNERS]).take(pa.array(out)).columns, pa.array(state[out] == 1)], [*key, "id", *CORNERS, "sure"])

    return run


def suppress_boxes(boxes: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """``suppress`` for axis-parallel boxes of whole numbers (key, id, x0, y0, x1, y1) that conflict where they overlap with at least ``threshold`` (over 0), without a table of conflicts, which grows with the square of a crowd.

    Boxes go to all cells that their centre comes near, and stream through each in the order of rank, to be compared only with those that stay, or of which that is open there: of the former no place has many. Near a cell's border it may be
    open whether a box stays; what the boxes' home cells leave open goes into another round with those that stay, in larger cells with other borders, as few are left. The first of all open boxes is settled in any round."""
    steps = Steps(boxes.sparkSession)
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.lit(True)
    for c in (*key, *CORNERS):
        whole &= F.col(c).isNotNull()
    live = steps.kept(boxes.where(whole).select(*key, "id", *(F.col(c).cast("long").alias(c) for c in CORNERS), F.lit(False).alias("sure")), "live-0")
    # what lacks a corner or its key conflicts with nothing
    other = boxes.where(~whole).select(*key, "id")
    wide = max(live.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1, 1)
    cell, halo = max(512, 3 * wide), 2 * math.ceil(_far(threshold) * wide + 2)
    n = 0
    while True:
        dealt = live
        home, inside = F.lit(True), F.lit(True)
        for at, lo, hi in (("_cx", "x0", "x1"), ("_cy", "y0", "y1")):
            middle = (F.col(lo) + F.col(hi)) / 2 - cell // 4
            reach = F.greatest(F.lit(0.0), (F.col(hi) - F.col(lo)) * _far(threshold)) + 1
            dealt = dealt.withColumn(at, F.explode(F.sequence(F.floor((middle - halo) / cell), F.floor((middle + halo) / cell))))
            home &= F.floor(middle / cell) == F.col(at)
            inside &= (middle - reach >= F.col(at) * cell - halo) & (middle + reach <= (F.col(at) + 1) * cell + halo)
        size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
        rows = dealt.withColumns({"home": home, "inside": inside}).repartition(tasks, *key, "_cx", "_cy").sortWithinPartitions(*key, "_cx", "_cy", size.desc(), F.desc("id"))
        n += 1
        live = steps.kept(rows.mapInArrow(_settled(key, threshold), live.schema), f"live-{n}")
        steps.drop(f"live-{n - 1}")
        if live.where("not sure").isEmpty():
            return live.select(*key, "id").unionByName(other)
        cell *= 2
