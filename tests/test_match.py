"""Matching, suppression and line distances against plain Python."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from vectorloom.functions import lines as L
from vectorloom.operators import match, rounds
from vectorloom.plans import queries


def test_greedy_against_fold(spark):
    r = random.Random(1)
    rows = sorted({(k, r.randint(0, 25), r.randint(0, 25)) for k in (1, 2) for _ in range(220)})
    rows = [(k, p, g, r.randint(0, 6)) for k, p, g in rows]
    want, used = set(), set()
    for d, k, p, g in sorted((d, k, p, g) for k, p, g, d in rows):
        if (k, "p", p) not in used and (k, "g", g) not in used:
            used |= {(k, "p", p), (k, "g", g)}
            want.add((k, p, g, d))
    df = spark.createDataFrame(rows, "k long, pred long, gt long, d long")
    assert {tuple(x) for x in match.greedy(df, ["k"], [F.col("d")], carry=["d"]).collect()} == want
    assert match.greedy(df.limit(0), ["k"], [F.col("d")]).count() == 0
    chain = spark.createDataFrame([(1, i // 2, (i + 1) // 2, i) for i in range(24)], "k long, pred long, gt long, d long")
    assert match.greedy(chain, ["k"], [F.col("d")]).count() == 12


def test_suppression_against_fold(spark):
    r = random.Random(2)
    size = {(k, i): r.randint(1, 9) for k in (1, 2) for i in range(40)}
    foes = {(k, *sorted(r.sample(range(40), 2))) for k in (1, 2) for _ in range(70)}
    want = set()
    for k, i in sorted(size, key=lambda n: (-size[n], -n[1])):
        if not any((k, *sorted((i, j))) in foes for q, j in want if q == k):
            want.add((k, i))
    features = spark.createDataFrame([(k, i, s) for (k, i), s in size.items()], "k long, id long, size long")
    conflicts = spark.createDataFrame([(k, b, a) for k, a, b in foes], "k long, a long, b long")
    for whole in (10_000, 20, 0):  # all components at once, some, none
        assert {tuple(x) for x in match.suppress(features, conflicts, ["k"], whole).collect()} == want
    assert match.suppress(features, conflicts.limit(0), ["k"]).count() == 80


def test_hausdorff_against_plain(monkeypatch):
    monkeypatch.setattr(L, "_COMBINATIONS", 7)
    r = random.Random(3)

    def gap(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        sq = dx * dx + dy * dy
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / sq)) if sq else 0
        return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1])

    line = lambda: [(r.randint(0, 9) * 1.0, r.randint(0, 9) * 1.0) for _ in range(r.choice((0, 1, 2, 3, 8)))]
    pairs = [(line(), line()) for _ in range(80)] + [(None, line())]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    column = lambda i: pa.array([None if p[i] is None else [{"x": x, "y": y} for x, y in p[i]] for p in pairs], kind)
    far = lambda a, b: max(min(gap(p, s, e) for s, e in zip(b, b[1:])) for p in a)
    for (a, b), got in zip(pairs, L.hausdorff_of(column(0), column(1)).to_pylist()):
        if not a or len(a) < 2 or len(b) < 2:
            assert got is None
        else:
            assert abs(got - max(far(a, b), far(b, a))) < 1e-9


def test_components_against_union_find(spark):
    from vectorloom.operators.components import components
    from vectorloom.operators.rounds import Steps

    r = random.Random(5)
    rows = [(k, r.randrange(300), r.randrange(300)) for k in (1, 2) for _ in range(150)] + [(3, i, i + 1) for i in range(200)] + [(4, 0, i) for i in range(1, 80)] + [(5, 7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, a, b in rows:
        if a != b:
            x, y = find((k, a)), find((k, b))
            root[max(x, y)] = min(x, y)
    edges = spark.createDataFrame(rows, "k long, a long, b long")
    got = {(x["k"], x["id"]): (x["k"], x["label"]) for x in components(edges, ["k"], Steps(spark)).collect()}
    assert got == {x: find(x) for x in root}


def test_polygon_pairs_against_all(spark):
    from vectorloom.functions import polygons as G

    r = random.Random(6)

    def star(n):
        x, y, s = r.uniform(-300, 600), r.uniform(-300, 600), r.uniform(5, 200)
        ring = lambda f: [(x + s * f * r.uniform(0.5, 1) * math.cos(2 * math.pi * i / n), y + s * f * r.uniform(0.5, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        return [ring(1.0)] + ([ring(0.2)] if r.random() < 0.4 else [])

    rows = [(k, i, star(r.randint(3, 9))) for k in (1, 2) for i in range(60)]
    rows += [(k, 100 + i, [[(x + 3, y - 2) for x, y in ring] for ring in p]) for k, i, p in rows[::3]]
    rows += [(1, 300, []), (1, 301, [[(0, 0), (20, 20), (20, 0), (0, 20)]]), (1, 302, [[(0, 0), (20, 0), (20, 20), (0, 20)]]), (1, 303, [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)]])]
    df = spark.createDataFrame([(k, i, [[(float(x), float(y)) for x, y in ring] for ring in p]) for k, i, p in rows], "k long, id long, rings array<array<struct<x:double,y:double>>>")
    want = {(k, i, j): G.iou(p, q) for k, i, p in rows for m, j, q in rows if k == m and p and q}
    want = {x: v for x, v in want.items() if v is not None and v >= 0.3}
    got = {(x["k"], x["pred"], x["gt"]): x["iou"] for x in match.polygon_pairs(df, df, ["k"], 0.3).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_crowded_cells_split(spark):
    """Half of all boxes in one cell: pairs are the same, found in many cells, and large boxes do not split theirs."""
    from vectorloom.operators import grid

    r = random.Random(7)
    spot = lambda n, x, y, wide, size: [(i, int(x + r.random() * wide), int(y + r.random() * wide), r.randint(*size)) for i in range(n)]
    rows = [(1, i, x, y, x + s, y + s + 1) for i, x, y, s in spot(400, 10, 10, 200, (3, 9))] + [(1, 1000 + i, x, y, x + s, y + s) for i, x, y, s in spot(300, -900, -900, 3000, (5, 60))] + [(2, i, x, y, x + s, y + s) for i, x, y, s in spot(150, 0, 0, 20, (200, 240))]
    df = spark.createDataFrame(rows, "k long, id long, x0 long, y0 long, x1 long, y1 long")
    want = {}
    for k, i, *a in rows:
        for m, j, *b in rows:
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if k == m and w > 0 and h > 0:
                v = w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)
                if v >= 0.2:
                    want[k, i, j] = round(v, 9)
    for most in (8, 10_000):
        assert {(x["k"], x["pred"], x["gt"]): round(x["iou"], 9) for x in match.box_pairs(df, df, ["k"], 0.2, most=most).collect()} == want
    box = [F.col("x0"), F.col("y0"), F.col("x1") - 1, F.col("y1") - 1]
    deep = {(x["k"], x["_cx"], x["_cy"]): x["_level"] for x in grid.levels(df, ["k"], box, 256, 8).collect()}
    assert deep[1, 0, 0] >= 3 and not any(k == 2 for k, _, _ in deep)
    spread = grid.dealt(df, ["k"], box, 256, grid.levels(df, ["k"], box, 256, 8)).where("k = 1 and id < 1000").groupBy("_level", "_fx", "_fy").count()
    assert spread.count() > 40 and spread.agg(F.max("count")).first()[0] < 60


def test_suppressed_boxes_without_their_conflicts(spark, monkeypatch):
    """Crowds and chains over many cells, against the rounds over all conflicts; what is written grows with the boxes, not with their pairs."""
    r = random.Random(3)
    boxes = [("s", i, x, y, x + w, y + h) for i in range(600) for x, y, w, h in [(r.randrange(-300, 900), r.randrange(500), r.randrange(1, 150), r.randrange(1, 90))]]
    boxes += [("t", i, 5 * i, 0, 5 * i + 40, 30) for i in range(400)] + [("u", i, i % 3, i % 2, 100, 100) for i in range(1500)]
    df = spark.createDataFrame(boxes, "k string, id long, x0 long, y0 long, x1 long, y1 long")
    got = {(x["k"], x["id"]) for x in match.suppress_boxes(df, ["k"], 0.5).collect()}
    want, kept = set(), []
    for k, i, *b in sorted(boxes, key=lambda x: (-(x[4] - x[2]) * (x[5] - x[3]), -x[1])):
        over = lambda c: max(0, min(b[2], c[2]) - max(b[0], c[0])) * max(0, min(b[3], c[3]) - max(b[1], c[1]))  # noqa: B023, E731
        area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
        if not any(m == k and over(c) / (area(b) + area(c) - over(c)) >= 0.5 for m, c in kept):
            kept.append((k, b))
            want.add((k, i))
    assert got == want and ("u", 1494) in got
    written, keep = [], rounds.Steps.kept
    monkeypatch.setattr(rounds.Steps, "kept", lambda self, df, name: (lambda out: written.append(out.count()) or out)(keep(self, df, name)))
    monkeypatch.setattr(queries, "_boxes", lambda s, d: df.where("k = 'u'").withColumnRenamed("k", "sample_id"))
    assert queries.dedup_nms(spark, "").count() == 1 and max(written) <= 1500


def test_crowded_boxes_take_few_rounds(spark, monkeypatch):
    """A crowd over many cells: cells show enough of their surroundings, and grow, so that little is left open; boxes without a corner or a key stay."""
    r = random.Random(5)
    boxes = [(1, i, x, y, x + w, y + h) for i in range(4000) for x, y, w, h in [(r.randrange(1500), r.randrange(700), r.randrange(20, 150), r.randrange(20, 90))]]
    made = lambda rows: spark.createDataFrame(rows, "k long, id long, x0 long, y0 long, x1 long, y1 long")
    names, keep = [], rounds.Steps.kept
    monkeypatch.setattr(rounds.Steps, "kept", lambda self, df, name: names.append(name) or keep(self, df, name))
    got = {x["id"] for x in match.suppress_boxes(made(boxes), ["k"], 0.5).collect()}
    over = lambda b, c: max(0, min(b[2], c[2]) - max(b[0], c[0])) * max(0, min(b[3], c[3]) - max(b[1], c[1]))
    area, kept = (lambda c: (c[2] - c[0]) * (c[3] - c[1])), {}
    for _, i, *b in sorted(boxes, key=lambda x: (-(x[4] - x[2]) * (x[5] - x[3]), -x[1])):
        if not any(over(b, c) / (area(b) + area(c) - over(b, c)) >= 0.5 for c in kept.values()):
            kept[i] = b
    assert got == set(kept) and len(names) <= 4
    odd = [(None, 1, 0, 0, 9, 9), (None, 2, 0, 0, 9, 9), (2, 1, 0, 0, 9, None), (2, 2, 0, 0, 9, 9), (2, 3, 0, 0, 9, 9), (2, 4, 5, 5, 5, 9)]
    assert sorted((x["k"] or 0, x["id"]) for x in match.suppress_boxes(made(odd), ["k"], 0.5).collect()) == [(0, 1), (0, 2), (2, 1), (2, 3), (2, 4)]


def test_boxes_matched_without_all_their_pairs(spark, monkeypatch):
    """By tiers of likeness as over all pairs; a crowd's pairs are never written as a whole, nor joined again for their corners."""
    r = random.Random(4)
    boxes = [(0, i, x, y, x + w, y + h) for i in range(260) for x, y, w, h in [(r.randrange(120), r.randrange(90), r.randrange(20, 90), r.randrange(20, 60))]]
    df = spark.createDataFrame(boxes, "k long, id long, x0 long, y0 long, x1 long, y1 long")
    moved = df.withColumns({c: F.col(c) + F.col("id") % 7 for c in ("x0", "x1")}).where("id % 9 > 0")
    every = match.box_pairs(moved, df, ["k"], 0.3)
    rows = lambda x: {tuple(v) for v in x.select("k", "pred", "gt", F.round("iou", 9)).collect()}
    want = rows(match.greedy(every, ["k"], [-F.round("iou", 9)], carry=["iou"]))
    written, keep = [], rounds.Steps.kept
    monkeypatch.setattr(rounds.Steps, "kept", lambda self, x, name: (lambda out: written.append(out.count()) or out)(keep(self, x, name)))
    assert rows(match.greedy_boxes(moved, df, ["k"], 0.3)) == want
    assert max(written) < every.count() / 4
    monkeypatch.setattr(queries, "_boxes", lambda s, d, shift=0: (moved if shift else df).withColumnRenamed("k", "sample_id"))
    plan = queries.polygon_iou_kernel(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_near_duplicates_meet_by_properties(spark):
    """A crowd in one place under names of its own has no candidates; equal properties meet, however they are written."""
    from vectorloom.functions import props as P
    from vectorloom.plans import jobs

    raster = spark.createDataFrame([(1, 1.0, 0.0, -1.0, 0.0)], "sample_id long, a double, c double, e double, f double")
    texts = [f'{{"Id":"L{i}"}}' for i in range(30)] + ['{"Id":"L0"}', '{ "Id" : "L1" }', '{"n":1,"Id":"x"}', '{"Id":"x","n":1.0}', '{"v":"1.5"}', '{"v":1.5}', "[1]", "[1]", None, None]
    square = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]
    point = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(1, i, t, square, [square]) for i, t in enumerate(texts)], f"sample_id long, id long, props string, line {point}, rings array<{point}>")
    seen = []
    real = match.suppress

    def told(features, conflicts, key, whole=match.WHOLE):
        seen.append(conflicts.count())
        return real(features, conflicts, key, whole)

    match.suppress = told
    try:
        for out in (jobs.dedup_areas(df, raster, 0.5), jobs.dedup_lines(df, raster, 1.0)):
            assert sorted(r["id"] for r in out.select("id").collect()) == [*range(2, 32), 33, *range(35, 40)]
    finally:
        match.suppress = real
    assert seen == [4, 4]
    rows = df.select("id", P.props_bucket("props").alias("b"), "props")
    pairs = rows.alias("x").crossJoin(rows.alias("y")).where(P.props_equal(F.col("x.props"), F.col("y.props")))
    assert pairs.where("not (x.b <=> y.b) or x.b is null").count() == 0
    assert rows.where("b is not null").select("b").distinct().count() == 32


def test_polygons_in_tiers(spark, monkeypatch):
    """Pairs at every threshold are those of plain Python, tiers match as all pairs do, and of slanting ribbons that crowd only those whose centres are near are swept."""
    from vectorloom.functions import polygons

    point = "array<struct<x:double,y:double>>"
    made = lambda rows: spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], f"k long, id long, rings array<{point}>")
    r = random.Random(8)

    def shape():
        x, y, w, h, s = r.uniform(0, 30), r.uniform(0, 30), r.uniform(20, 30), r.uniform(20, 30), r.uniform(-8, 8)
        ring = [(x, y), (x + w, y + s), (x + w, y + s + h), (x + w / 2, y + h), (x, y + h)]
        hole = [(x + 4, y + 9), (x + 8, y + 9), (x + 8, y + 11)]
        return [ring, hole] if r.random() < 0.2 else [ring[::-1] if r.random() < 0.5 else ring]

    left, right = [shape() for _ in range(50)], [shape() for _ in range(50)]
    right[:10] = [[[(x + 0.5 * (i % 3), y) for x, y in ring] for ring in left[i]] for i in range(10)]
    every = {(i, j): polygons.iou(a, b) for i, a in enumerate(left) for j, b in enumerate(right)}
    for threshold in (0.3, 0.7, 0.95):
        got = {(p, g): iou for _, p, g, iou in match.polygon_pairs(made(left), made(right), ["k"], threshold, cell=16.0).collect()}
        assert got.keys() == {k for k, v in every.items() if v >= threshold}
        assert all(abs(every[k] - v) < 1e-9 for k, v in got.items())
    want, used = set(), set()
    for _, p, g in sorted((-round(v, 9), *k) for k, v in every.items() if v >= 0.3):
        if ("p", p) not in used and ("g", g) not in used:
            used |= {("p", p), ("g", g)}
            want.add((p, g))
    assert {(x["pred"], x["gt"]) for x in match.greedy_polygons(made(left), made(right), ["k"], 0.3).collect()} == want
    ribbons = [[[(0.0, 2.0 * i), (100.0, 100.0 + 2 * i), (100.0, 104.0 + 2 * i), (0.0, 4.0 + 2 * i)]] for i in range(100)]
    monkeypatch.setattr(polygons, "iou_column", lambda a, b: F.lit(1.0))
    assert match.polygon_pairs(made(ribbons), made(ribbons), ["k"], 0.9).count() < 2200


def test_pairs_of_polygons_by_profile(spark, monkeypatch):
    """Polygons that an upright line cuts in one stretch are measured as the sweep does, far from the origin, too; they travel once a cell and are not swept; others are, among them those beside one with a profile."""
    from vectorloom.functions import polygons

    point = "array<struct<x:double,y:double>>"
    made = lambda rows: spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], f"k long, id long, rings array<{point}>")
    r = random.Random(6)

    def ribbon(far=0.0):
        xs = [far + r.uniform(0, 40)]
        for _ in range(r.randint(1, 6)):
            xs.append(xs[-1] + r.uniform(1, 20))
        low = [far * 4 + r.uniform(0, 30) for _ in xs]
        ring = list(zip(xs, low)) + [(x, y + r.uniform(4, 30)) for x, y in reversed(list(zip(xs, low)))]
        turn = r.randrange(len(ring))
        ring = ring[turn:] + ring[:turn]
        return ring[::-1] if r.random() < 0.5 else ring

    for far in (0.0, 1e6):
        left, right = ([[ribbon(far)] for _ in range(60)] for _ in range(2))
        a, b = polygons.profiles_of(polygons.polygons(left)), polygons.profiles_of(polygons.polygons(right))
        assert not a.null_count and not b.null_count
        want = {(i, j): polygons.iou(x, y) for i, x in enumerate(left) for j, y in enumerate(right)}
        swept = []
        monkeypatch.setattr(polygons, "iou_column", lambda *x: swept.append(x))
        got = {(p, g): v for _, p, g, v in match.polygon_pairs(made(left), made(right), ["k"], 0.2, cell=16.0).collect()}
        assert not swept and got.keys() == {k for k, v in want.items() if v >= 0.2} and all(abs(want[k] - v) < 1e-6 for k, v in got.items())
    odd = [[(0, 0), (9, 0), (9, 9), (4, 9), (4, 4), (2, 4), (2, 9), (0, 9)], [(0, 0), (9, 9), (9, 0), (0, 9)], [(0, 0), (9, 0), (3, 3), (9, 9), (0, 9)], [(0, 0), (0, 9), (0, 18)], [(0, 0), (5, 1)], [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(0, 0), (4, 0), (4, 4), (5, 0), (9, 0), (9, 9), (0, 9)]]
    told = polygons.profiles_of(polygons.polygons([[x] for x in odd] + [None, [], [odd[0], odd[0]]]))
    assert told.is_valid().to_pylist() == [False] * 5 + [True] + [False] * 4
    pairs = {(p, g): v for _, p, g, v in match.polygon_pairs(made([[[(float(x), float(y)) for x, y in odd[0]]]]), made([[[(float(x), float(y)) for x, y in z]] for z in odd]), ["k"], 0.1).collect()}
    assert pairs.keys() == {(0, 0), (0, 2), (0, 5), (0, 6)} and abs(pairs[0, 5] - 71 / 81) < 1e-12 and pairs[0, 0] == 1
