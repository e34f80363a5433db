"""Kernels against hand-computed cases and plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import coords as C
from vectorloom.functions import lines as L
from vectorloom.functions import polygons as G
from vectorloom.functions import props as P
from vectorloom.operators import pieces, tokens

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def line_(spark, pts):
    return line(spark, pts)


def line(spark, pts):
    return spark.createDataFrame([([(float(x), float(y)) for x, y in pts],)], "line array<struct<x:double,y:double>>")


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def pairs(rows):
    return [(round(p["x"], 6), round(p["y"], 6)) for p in rows]


def test_utm_known_point_and_back(spark):
    df = spark.createDataFrame([(117.0, 0.0), (116.630, 40.078)], "lon double, lat double")
    e, n = C.project(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:32650")
    rows = df.select("lon", "lat", e.alias("e"), n.alias("n")).withColumns(dict(zip(("x", "y"), C.project(F.col("e"), F.col("n"), "EPSG:32650", C.CRS84), strict=True))).collect()
    assert rows[0]["e"] == pytest.approx(500000, abs=1e-6) and rows[0]["n"] == pytest.approx(0, abs=1e-6)
    for r in rows:
        assert r["x"] == pytest.approx(r["lon"], abs=1e-9) and r["y"] == pytest.approx(r["lat"], abs=1e-9)
    with pytest.raises(ValueError):
        C.utm_zone("EPSG:3857")


@pytest.mark.parametrize(
    ("pts", "want"),
    [
        ([(1, 1), (3, 3)], [[(1, 1), (3, 3)]]),
        ([(-2, 2), (6, 2)], [[(0, 2), (4, 2)]]),
        ([(1, 1), (6, 1), (6, 3), (1, 3)], [[(1, 1), (4, 1)], [(4, 3), (1, 3)]]),
        ([(0, -1), (0, 5)], [[(0, 0), (0, 4)]]),
        ([(-1, 1), (1, -1)], []),
        ([(9, 9), (10, 10)], []),
    ],
)
def test_line_clip(spark, pts, want):
    got = value(line(spark, pts), pieces.clip_line(F.col("line"), *(F.lit(v) for v in (0.0, 0.0, 4.0, 4.0))))
    assert [pairs(p) for p in got] == want


@pytest.mark.parametrize(("pts", "closed", "want"), [([(0, 0), (10, 0)], False, 4), ([(0, 0)], False, 1), ([(1, 1), (1, 1)], False, 1), ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], True, 5)])
def test_resample(spark, pts, closed, want):
    got = value(line(spark, pts), L.resample(F.col("line"), 3.0, 100, closed))
    assert len(got) == want
    if not closed and want > 1:
        assert pairs(got)[0] == pts[0] and pairs(got)[-1] == pts[-1]


def test_hausdorff(spark):
    a = line(spark, [(0, 0), (10, 0)])
    other = lambda *p: F.array(*(L.point(F.lit(float(x)), F.lit(float(y))) for x, y in p))
    assert value(a, L.hausdorff(F.col("line"), other((10, 0), (0, 0)))) == 0
    assert value(a, L.hausdorff(F.col("line"), other((0, 2), (10, 2)))) == 2
    assert value(a, L.hausdorff(F.col("line"), other((0, 0), (5, 0)))) == 5


def plain_overlap(a, b):
    """Areas of both polygons and of their intersection, by slabs between all heights that matter."""
    edges = lambda rings: [((*p, *q) if p[1] < q[1] else (*q, *p)) for r in rings for p, q in zip(r, r[1:] + r[:1]) if p[1] != q[1]]
    at = lambda e, y: e[0] + (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1])
    ea, eb = edges(a), edges(b)
    ys = {y for e in ea + eb for y in (e[1], e[3])}
    for i, e in enumerate(ea + eb):
        for f in (ea + eb)[:i]:
            low, high = max(e[1], f[1]), min(e[3], f[3])
            if low < high:
                p, q = at(e, low) - at(f, low), at(e, high) - at(f, high)
                if p * q < 0:
                    ys.add(low + (high - low) * p / (p - q))
    out = [0.0, 0.0, 0.0]
    for low, high in zip(sorted(ys), sorted(ys)[1:]):
        mid = (low + high) / 2
        spans = []
        for es in (ea, eb):
            x = sorted(at(e, mid) for e in es if e[1] <= low and e[3] >= high)
            spans.append(list(zip(x[::2], x[1::2])))
        out[0] += (high - low) * sum(q - p for p, q in spans[0])
        out[1] += (high - low) * sum(q - p for p, q in spans[1])
        out[2] += (high - low) * sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p in spans[0] for q in spans[1])
    return out


def test_sweep_against_slabs(monkeypatch):
    rnd = random.Random(3)

    def ring(x, y, r, n):
        return [(x + r * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + r * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]

    grid = lambda: [(float(rnd.randint(0, 6)), float(rnd.randint(0, 6))) for _ in range(rnd.randint(3, 8))]
    pairs = [([ring(5, 5, 6, rnd.randint(3, 12)), ring(5, 5, 2, 5)], [ring(7, 6, 5, rnd.randint(3, 12))]) for _ in range(60)]
    pairs += [([grid()], [grid(), grid()]) for _ in range(60)] + [([], [grid()]), (None, [grid()]), ([[(1.0, 1.0)]], [grid()])]
    for most in (5, 1_000_000):
        monkeypatch.setattr(G, "COMBINATIONS", most)
        areas, both, crossed = G.swept(G.polygons([a for a, _ in pairs]), G.polygons([b for _, b in pairs]))
        for k, (a, b) in enumerate(pairs):
            assert [*areas[k], both[k]] == pytest.approx(plain_overlap(a or [], b), abs=1e-7)
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    for k, (a, _) in enumerate(pairs):
        es = list(zip(a[0], a[0][1:] + a[0][:1])) if a else []
        assert crossed[k, 0] == any(turn(*e, f[0]) * turn(*e, f[1]) < 0 and turn(*f, e[0]) * turn(*f, e[1]) < 0 for i, e in enumerate(es) for f in es[:i])


def test_clip_column_takes_whole_rings_as_they_are():
    box = [np.full(7, v) for v in (0.0, 0.0, 4.0, 4.0)]
    box[0][5] = np.nan
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]
    rows = [[SQUARE], [[(9, 9), (10, 9), (10, 10)]], [[(2, 2), (6, 2), (6, 6), (2, 6)]], [bow], None, [SQUARE], []]
    got = G.clip_of(G.polygons(rows), box).to_pylist()
    area = lambda r: abs(G.ring_area([(p["x"], p["y"]) for p in r]))
    assert [None if g is None else [[area(r) for r in p] for p in g] for g in got] == [[[16.0]], [], [[4.0]], [], None, None, []]


def test_polygon_iou():
    shift = lambda r, d: [(x + d, y) for x, y in r]
    assert G.iou([SQUARE], [SQUARE]) == pytest.approx(1)
    assert G.iou([SQUARE], [shift(SQUARE, 9)]) == 0
    assert G.iou([SQUARE], [shift(SQUARE, 2)]) == pytest.approx(8 / 24)
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    assert G.iou([SQUARE, hole], [hole]) == pytest.approx(0)
    assert G.iou([SQUARE, hole], [SQUARE]) == pytest.approx(12 / 16)
    assert G.iou([[(0, 0), (2, 2), (2, 0), (0, 2)]], [SQUARE]) is None


def test_polygon_clip():
    u = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]
    got = G.clip([[(float(x), float(y)) for x, y in u]], (-1.0, 3.0, 7.0, 5.0))
    assert sorted(abs(G.ring_area(p[0])) for p in got) == [4, 4]
    assert [abs(G.ring_area(p[0])) for p in G.clip([SQUARE], (1.0, 1.0, 9.0, 9.0))] == [9]
    assert G.clip([SQUARE], (5.0, 5.0, 6.0, 6.0)) == []
    inner = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    assert len(G.clip([SQUARE, inner], (-1.0, -1.0, 9.0, 9.0))[0]) == 2


def test_polygon_clip_with_holes_that_cut():
    ten = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    block = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    two = G.clip([ten, block(4.0, 1.0, 6.0, 9.0)], (-1.0, 3.0, 11.0, 7.0))
    assert sorted(abs(G.ring_area(p[0])) for p in two) == [16, 16] and all(len(p) == 1 for p in two)
    notch = G.clip([ten, block(4.0, 4.0, 6.0, 9.0)], (-1.0, 3.0, 11.0, 7.0))
    assert [(abs(G.ring_area(p[0])), len(p)) for p in notch] == [(34, 1)]
    kept = G.clip([ten, block(1.0, 1.0, 2.0, 2.0), block(7.0, 4.0, 8.0, 5.0)], (-1.0, 3.0, 11.0, 7.0))
    assert [len(p) for p in kept] == [2]
    rnd = random.Random(7)
    for _ in range(60):
        ring = lambda r, n: [(10 + r * rnd.uniform(0.7, 1) * math.cos(2 * math.pi * i / n), 10 + r * rnd.uniform(0.7, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        rings = [ring(8, rnd.randint(5, 9)), ring(3, rnd.randint(3, 6))]
        box = (rnd.uniform(0, 9), rnd.uniform(0, 9), rnd.uniform(11, 20), rnd.uniform(11, 20))
        if not G.simple(rings[0]) or not G.simple(rings[1]) or plain_overlap([rings[0]], [rings[1]])[2] < plain_overlap([rings[1]], [rings[1]])[0] - 1e-9:
            continue
        area = sum(abs(G.ring_area(p[0])) - sum(abs(G.ring_area(h)) for h in p[1:]) for p in G.clip(rings, box))
        assert area == pytest.approx(plain_overlap(rings, [block(*box)])[2], abs=1e-6)


def test_polygon_clip_area_against_overlap():
    rnd = random.Random(5)
    for _ in range(60):
        n = rnd.randint(3, 9)
        ring = [(10 + 8 * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), 10 + 8 * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        if not G.simple(ring):
            continue
        box = (rnd.uniform(0, 9), rnd.uniform(0, 9), rnd.uniform(11, 20), rnd.uniform(11, 20))
        square = [(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]
        area = sum(abs(G.ring_area(p[0])) for p in G.clip([ring], box))
        assert area == pytest.approx(plain_overlap([ring], [square])[2], abs=1e-6)


@pytest.mark.parametrize(("a", "b", "same"), [({"w": 1}, {"w": 1.0}, True), ({"w": None}, {"w": None}, True), ({"w": 3.5}, {"w": 3.5000001}, True), ({"w": 3.5}, {"w": None}, False), ({"w": 1}, {"w": "1"}, False), ({"w": 1}, {}, False), ({"w": 1.5}, {"w": "x"}, False)])
def test_props_equal(a, b, same):
    assert P.equal(a, b) is same


def test_json_recovery():
    assert P.first_object('so: {"a": 1} and {"b": 2}') == '{"a":1}'
    assert P.first_object('{broken {"a": {"b": "}"}} x') == '{"a":{"b":"}"}}'
    assert P.first_object("[1]") is None and P.first_object("") is None
    assert P.parse("{'a': true}") == {"a": True}
    assert P.parse("{“a”：1}") == {"_raw_text": "{“a”：1}"}
    assert P.parse_relaxed("{“a”：1，}") == {"a": 1}
    assert P.parse_relaxed('"a": 1，') == {"a": 1} and P.parse_relaxed("'a': NULL") == {"a": None} and P.parse_relaxed("a: 1") == {"_raw_text": "a: 1"}
    assert P.parse("{'a': TRUE, 'b': null,}") == {"a": True, "b": None} and P.parse('{"a"：1，}') == {"a": 1} and P.parse(None) == {}
    assert P.parse("nonsense") == {"_raw_text": "nonsense"}
    deep = '{"a":' * 100_000
    assert P.first_object(deep) is None and P.parse(deep) == {"_raw_text": deep} and P.parse_relaxed(deep)["_raw_text"] == deep and P.first_object("{" * 100_000) is None


def test_collections(spark):
    crs = {"type": "name", "properties": {"name": P.CRS84}}
    feature = {"type": "Feature", "properties": {"b": 1, "a": None}, "geometry": None}
    cases = [
        ({"type": "FeatureCollection", "features": [feature], "x": 1}, {"type": "FeatureCollection", "name": "L", "crs": crs, "features": [feature], "x": 1}),
        ({"type": "FeatureCollection", "features": [], "name": "N", "crs": {"q": 1}}, {"type": "FeatureCollection", "features": [], "name": "N", "crs": {"q": 1}}),
        (feature, {"type": "FeatureCollection", "name": "L", "crs": crs, "features": [feature]}),
        ({"features": [feature], "name": ""}, {"type": "FeatureCollection", "name": "L", "crs": crs, "features": [feature]}),
        ({"features": [], "name": 'q"', "crs": None}, {"type": "FeatureCollection", "name": 'q"', "crs": None, "features": []}),
        ({"type": "FeatureCollection"}, None), ({"type": "FeatureCollection", "features": {}}, None), ({"a": 1}, None), ([1], None),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(98, "no json"), (99, None)]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i long, t string").select("i", P.collection(F.col("t"), "L").alias("c")).collect()}
    for i, (_, want) in enumerate(cases):
        assert (got[i] and json.loads(got[i])) == want
    assert got[98] is None and got[99] is None


def test_typed_equality_in_columns(spark):
    values = [None, True, False, 0, 1, 2, 1.0, 1.5, 1.5000001, 1e3, "1", "1.5", "x", "", [1], [2], {"k": 1}, {"k": None}]
    sides = [{"w": v} for v in values] + [{}, {"v": 1}, {"w": 1, "v": "a"}, {"v": "a", "w": True}]
    rows = [(i, j, json.dumps(a), json.dumps(b)) for i, a in enumerate(sides) for j, b in enumerate(sides)]
    df = spark.createDataFrame([*rows, (-1, 0, None, "{}"), (-2, 0, "no json", "no json"), (-3, 0, "[1]", "[1]")], "i long, j long, a string, b string")
    got = {(r["i"], r["j"]): r["same"] for r in df.select("i", "j", P.props_equal(F.col("a"), F.col("b")).alias("same")).collect()}
    assert all(got[i, j] == P.equal(sides[i], sides[j]) for i in range(len(sides)) for j in range(len(sides)))
    assert [got[k, 0] for k in (-1, -2, -3)] == [None, False, False]
    assert df.where("i < 0").select(P.canonical_udf("a").alias("c"), P.first_object_udf("a").alias("f"), P.parse_udf("a").alias("p")).count() == 3


@pytest.mark.parametrize("geometry", ["linestring", "polygon"])
def test_token_codec(spark, geometry):
    """What is decoded is what was encoded, up to the bins: points, rings, cuts, source and properties, in canonical order."""
    r = random.Random(6)
    size, bins = 256, 640
    near = lambda v: round(v / (size - 1) * (bins - 1)) / (bins - 1) * (size - 1)
    ring = lambda n: [(r.uniform(0, 255), r.uniform(0, 255)) for _ in range(n)]
    sides = ["none", "left", "top", "right", "bottom", "internal"]
    rows = []
    for i in range(30):
        rings = [ring(r.randint(3, 6)) for _ in range(r.randint(1, 3))] if geometry == "polygon" else [ring(r.randint(2, 6))]
        rows.append((1, rings[0], rings, r.choice(["local", "state"]), r.choice(sides), r.choice(sides), json.dumps({"Id": f"é{i} <eos>", "k": [1, None]}, ensure_ascii=False)))
    kind = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame(rows, f"k int, line {kind}, rings array<{kind}>, source string, cut_in string, cut_out string, props string")
    ids = tokens.encode_items(df, ["k"], size, bins, geometry).first()["ids"]
    items, saw = tokens.decode(ids, geometry, 3 if geometry == "polygon" else 2, size, bins)
    assert saw and len(items) == 30
    order = sorted(rows, key=lambda x: (x[1][0][1], x[1][0][0], x[1][-1][1], x[1][-1][0], len(x[1]), x[6]))
    for got, (_, line, rings, source, cut_in, cut_out, props) in zip(items, order):
        assert (got["source"], got["cut_in"], got["cut_out"]) == (source, cut_in, cut_out)
        assert got["parsed"] == json.loads(props) and got["parse_ok"]
        parts = got["rings"] if geometry == "polygon" else [got["points"]]
        for a, b in zip(parts, rings if geometry == "polygon" else [line], strict=True):
            assert [tuple(round(v, 6) for v in q) for q in a] == [(round(near(x), 6), round(near(y), 6)) for x, y in b]
    assert tokens.decode(ids[:-40], geometry, 2, size, bins)[1] and tokens.decode([], geometry, 2, size, bins) == ([], False)


def test_image_turns_follow_points(spark):
    import numpy as np

    from vectorloom.functions import images
    from vectorloom.operators import synthesis

    for rot, h, v in ((0, True, False), (1, False, False), (2, False, True), (3, True, True)):
        px = np.zeros((5, 5, 1))
        px[1, 3] = 1
        moved = value(line(spark, [(3, 1)]), synthesis.augmented(F.col("line"), 5, F.lit(rot), F.lit(h), F.lit(v)))[0]
        assert images.turned(px, rot, h, v)[int(moved["y"]), int(moved["x"]), 0] == 1


def test_images():
    import numpy as np

    from vectorloom.functions import images

    flat = np.full((3, 6, 2), 51.0)
    box = images.letterboxed(flat, 8, 8, 4, 0, 2)
    assert box.shape == (2, 8, 8) and np.allclose(box[:, 2:6], 0.2) and not box[:, :2].any()
    mask = np.ones((4, 4))
    assert images.reviewed(np.ones((3, 3, 1)), mask, (2, 2, 5, 5)).sum() == 4
    assert images.reviewed(np.ones((3, 3, 1)), mask, (-1, -1, 2, 2)).sum() == 4


def test_prompts(spark):
    from vectorloom.functions import prompts

    df = spark.sql("select array(named_struct('side', 'left', 'line', array(named_struct('x', 1d, 'y', 2d)))) a, array(named_struct('cut_in', 'left', 'cut_out', 'none')) t")
    assert value(df, prompts.state_text(F.col("a"), F.lit("{}"))) == "State anchors=1\nidx=000 side=left points=1.0,2.0\nStateGeoJSON {}"
    assert value(df, prompts.target_text(F.col("t"), F.lit("{}"))) == "Targets features=1\nidx=000 cut_in=left cut_out=none\n{}"
    assert value(df, prompts.task_prompt(F.lit("m"), F.lit(""), F.lit("b"), F.lit("r"), F.lit(False))) == "m b r"


def test_lines_are_split_where_they_cross_themselves(spark):
    rnd = random.Random(8)
    lines = [[(float(rnd.randint(0, 30)), float(rnd.randint(0, 30)) + rnd.random()) for _ in range(rnd.randint(2, 9))] for _ in range(60)]
    lines += [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, -2.0)], [(0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (0.0, 0.0)], [(1.0, 1.0)], [], None]
    column = G.polygons([None if x is None else [x] for x in lines])
    import pyarrow as pa

    rows = pa.array([None if x is None else x[0] for x in column.to_pylist()], G._POLYGON.value_type)
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    for line, parts in zip(lines, G.noded_of(rows).to_pylist()):
        if line is None:
            assert parts is None
            continue
        es = list(zip(line, line[1:]))
        n = sum(turn(*e, f[0]) * turn(*e, f[1]) < 0 and turn(*f, e[0]) * turn(*f, e[1]) < 0 for i, e in enumerate(es) for f in es[:i])
        parts = [[(p["x"], p["y"]) for p in z] for z in parts]
        assert len(parts) == 1 + 2 * n and all(a[-1] == b[0] for a, b in zip(parts, parts[1:]))
        length = lambda z: sum(math.dist(a, b) for a, b in zip(z, z[1:]))
        assert sum(map(length, parts)) == pytest.approx(length(line))
    df = line_(spark, [(0, 0), (4, 4), (4, 0), (0, 4)]).withColumn("cut_start", F.lit(False)).withColumn("cut_end", F.lit(False))
    got = pieces.clipped(df, [F.lit(v) for v in (0.0, 0.0, 4.0, 4.0)]).collect()
    assert [pairs(g["line"]) for g in got] == [[(0, 0), (2, 2)], [(2, 2), (4, 4), (4, 0), (2, 2)], [(2, 2), (0, 4)]]
    assert [(g["cut_start"], g["cut_end"]) for g in got] == [(False, True), (True, True), (True, False)]


def test_resize_against_loops():
    from vectorloom.functions import images

    rng = np.random.default_rng(1)
    px = rng.integers(0, 255, (11, 17, 2))
    for w, h in ((5, 4), (17, 11), (40, 3), (1, 1), (23, 30)):
        def share(old, new, i, j):
            scale = old / new
            return max(0.0, 1 - abs(j + 0.5 - (i + 0.5) * scale) / max(scale, 1))

        got = images.resized(px, w, h)
        for y in range(h):
            for x in range(w):
                s = [(share(11, h, y, b) * share(17, w, x, a), px[b, a]) for b in range(11) for a in range(17)]
                assert got[y, x] == pytest.approx(sum(k * p for k, p in s) / sum(k for k, _ in s))
    assert images.resized(np.full((9, 9, 1), 7.0), 2, 5) == pytest.approx(np.full((5, 2, 1), 7.0))
