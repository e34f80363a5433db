"""Preparation, prediction and evaluation against plain Python on small random features."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from vectorloom.functions import lines as L
from vectorloom.operators import prepare, tiles
from vectorloom.plans import jobs

KIND = "array<struct<x:double,y:double>>"


def clip(line, box):
    """Pieces inside a closed box, segment by segment."""
    x0, y0, x1, y1 = box
    out, ended = [], None
    for k, (a, b) in enumerate(zip(line, line[1:])):
        t0, t1 = 0.0, 1.0
        d = (b[0] - a[0], b[1] - a[1])
        ok = True
        for axis, low, high in ((0, x0, x1), (1, y0, y1)):
            if d[axis] == 0:
                ok &= low <= a[axis] <= high
            else:
                enter, leave = sorted(((low - a[axis]) / d[axis], (high - a[axis]) / d[axis]))
                t0, t1 = max(t0, enter), min(t1, leave)
        if not ok or t0 >= t1:
            continue
        at = lambda t: a if t == 0 else b if t == 1 else (a[0] + t * d[0], a[1] + t * d[1])  # noqa: B023, E731
        if ended == k and t0 == 0:
            out[-1].append(at(t1))
        else:
            out.append([at(t0), at(t1)])
        ended = k + 1 if t1 == 1 else None
    return out


def split(line):
    """Parts between the points where a line crosses itself."""
    es, cuts = list(zip(line, line[1:])), []
    for i, (a, b) in enumerate(es):
        for c, d in es[:i] + es[i + 1 :]:
            by = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if by:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / by
                u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / by
                if 1e-9 < t < 1 - 1e-9 and 1e-9 < u < 1 - 1e-9:
                    (p, q), v = ((a, b), t) if (a, b) < (c, d) else ((c, d), u)  # one point for both
                    cuts.append((i, t, p[0] + v * (q[0] - p[0]), p[1] + v * (q[1] - p[1])))
    out, part, done = [], [], 0
    for i, _, *at in sorted(cuts):
        at = tuple(at)
        out.append([*part, *line[done : i + 1], at])
        part, done = [at], i + 1
    return [*out, [*part, *line[done:]]]


def close(p, q):
    return all(abs(u - v) <= 1e-3 + 1e-5 * abs(v) for u, v in zip(p, q))


def cut(pieces, source, start, end):
    return [(p, start or not close(p[0], source[0]), end or not close(p[-1], source[-1])) for p in pieces]


def meets(line, box):
    xs, ys = zip(*line)
    return not (max(xs) < box[0] or min(xs) >= box[2] or max(ys) < box[1] or min(ys) >= box[3])


def resample(line, interval):
    cum = [0.0]
    for a, b in zip(line, line[1:]):
        cum.append(cum[-1] + math.dist(a, b))
    total = cum[-1]
    if total < 1e-6:
        return line[:1]
    n = min(max(int(total // interval) + 1, 2), max(4, 2 * len(line)))
    out = []
    for i in range(n):
        t = total if i == n - 1 else i * total / (n - 1)
        k = min(max(sum(c <= t for c in cum), 1), len(line) - 1)
        span = cum[k] - cum[k - 1]
        r = (t - cum[k - 1]) / span if span else 0
        out.append((line[k - 1][0] + r * (line[k][0] - line[k - 1][0]), line[k - 1][1] + r * (line[k][1] - line[k - 1][1])))
    return out


def sort_key(line, props):
    return (line[0][1], line[0][0], line[-1][1], line[-1][0], len(line), props)


def runs(inside):
    out, k = [], 0
    while k < len(inside):
        if inside[k]:
            e = k
            while e < len(inside) and inside[e]:
                e += 1
            out.append((k, e))
            k = e
        k += 1
    return out


def prepared(features, box, strips, interval, most, inside):
    out = []
    for i, props, line in sorted(features, key=lambda f: (*sort_key(f[2], f[1]), f[0])):
        for k, e in [r for r in runs(inside[i]) if r[1] - r[0] >= 2] if inside else [(0, len(line))]:
            segment = line[k:e]
            if not meets(segment, box):
                continue
            parts = cut([p for part in split(segment) for p in clip(part, box)], segment, k > 0, e < len(line))
            if strips is not None:
                parts = [q for p, s, f in parts for strip in strips if meets(p, strip) for q in cut(clip(p, strip), p, s, f)]
            out += [(i, props, resample(p, interval) if interval else p, s, f) for p, s, f in parts]
    out = out[:most] if most else out
    return sorted(out, key=lambda r: sort_key(r[2], r[1]))


def walk(r, n):
    x, y = r.uniform(0, 100), r.uniform(0, 100)
    out = []
    for _ in range(n):
        x, y = x + r.uniform(-30, 40), y + r.uniform(-30, 40)
        out.append((x, y))
    return out


@pytest.mark.parametrize(("strips", "interval", "most", "mask"), [(None, None, 0, False), (None, 15.0, 9, True), ([(20.0, 20.0, 50.0, 120.0), (20.0, 20.0, 120.0, 45.0)], 7.0, 0, False), ([(20.0, 20.0, 50.0, 120.0), (20.0, 20.0, 120.0, 45.0)], None, 5, True)])
def test_prepared_lines(spark, strips, interval, most, mask):
    r = random.Random(11)
    box = (20.0, 20.0, 120.0, 120.0)
    features = [(i, json.dumps({"k": i % 3}), walk(r, r.randint(2, 7))) for i in range(40)]
    inside = {i: [r.random() < 0.7 for _ in line] for i, _, line in features} if mask else None
    want = prepared(features, box, strips, interval, most, inside)
    df = spark.createDataFrame([(1, *f) for f in features], f"sample_id long, feature_id long, props string, line {KIND}")
    tile = spark.createDataFrame([(1, 0, *map(int, box))], "sample_id long, tile_index long, x0 long, y0 long, x1 long, y1 long")
    told = strips and spark.createDataFrame([(1, 0, k, *map(int, s)) for k, s in enumerate(strips)], "sample_id long, tile_index long, strip int, sx0 long, sy0 long, sx1 long, sy1 long")
    hits = spark.createDataFrame([(1, i, k, v) for i, flags in inside.items() for k, v in enumerate(flags)], "sample_id long, feature_id long, pt long, inside boolean") if mask else None
    got = prepare.lines(df, tile, 2, interval, most, hits, told).orderBy("place").collect()
    assert [(g["feature_id"], g["props"], g["cut_start"], g["cut_end"], g["clipped"], len(g["line"])) for g in got] == [(i, p, s, e, s or e, len(line)) for i, p, line, s, e in want]
    for g, (_, _, line, _, _) in zip(got, want):
        assert all(math.dist((a["x"], a["y"]), b) < 1e-6 for a, b in zip(g["line"], line))


def test_prepared_areas(spark):
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    rows = [(1, 1, "{}", [ring(0.0, 0.0, 10.0, 10.0), ring(4.0, 1.0, 6.0, 9.0)]), (1, 2, "{}", [ring(1.0, 4.0, 3.0, 6.0)]), (1, 3, "{}", [ring(50.0, 50.0, 60.0, 60.0)])]
    df = spark.createDataFrame(rows, "sample_id long, feature_id long, props string, rings array<array<struct<x:double,y:double>>>")
    tile = spark.createDataFrame([(1, 0, -1, 3, 20, 7)], "sample_id long, tile_index long, x0 long, y0 long, x1 long, y1 long")
    area = lambda g: sum(g["line"][i - 1]["x"] * g["line"][i]["y"] - g["line"][i]["x"] * g["line"][i - 1]["y"] for i in range(len(g["line"]))) / 2
    got = sorted((g["feature_id"], round(abs(area(g)), 6), g["clipped"]) for g in prepare.areas(df, tile).collect())
    assert got == [(1, 16.0, True), (1, 16.0, True), (2, 4.0, False)]
    ratios = spark.createDataFrame([(1, 1, False, True), (1, 2, True, True)], "sample_id long, feature_id long, ok boolean, partial boolean")
    assert [(g["feature_id"], g["clipped"]) for g in prepare.areas(df, tile, ratios=ratios).collect()] == [(2, True)]
    strips = spark.createDataFrame([(1, 0, 0, -1, 3, 2, 7)], "sample_id long, tile_index long, strip int, sx0 long, sy0 long, sx1 long, sy1 long")
    assert sorted((g["feature_id"], round(abs(area(g)), 6)) for g in prepare.areas(df, tile, strips=strips).collect()) == [(1, 8.0), (2, 2.0)]


def test_prediction_from_answers(spark):
    """Lines in two halves join across tiles, noise and empty answers count as said, state tells the second tile of the first, near-duplicates go."""
    from vectorloom.plans.more import UTM

    raster = spark.createDataFrame([(1, 1400, 700, 1.0, 0.0, 1.0, 0.0)], "sample_id long, width int, height int, a double, c double, e double, f double")
    scan = tiles.scan_order(tiles.generate(raster, 768, 192, 96))
    assert scan.count() == 3
    lane = lambda name, *pts: {"type": "Feature", "properties": {"Id": name}, "geometry": {"type": "LineString", "coordinates": [[float(x), float(y), 0.0] for x, y in pts]}}
    say = lambda *f: "Sure: " + json.dumps({"type": "FeatureCollection", "features": list(f)}) + " done"
    texts = {
        0: say(lane("a", (500, 100), (670, 100)), lane("b", (10, 10), (20, 20)), lane("c", (600, 50), (760, 50)), {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 1]}}),
        1: say(lane("a", (672, 100), (900, 100)), lane("d", (700, 300), (800, 300)), lane("d", (700, 300), (800, 300.5)), lane("far", (5, 5), (6, 6))),
        2: "",
    }
    answers = spark.createDataFrame([(1, k, t) for k, t in texts.items()], "sample_id long, tile_index long, text string")
    p = jobs.predict(answers, scan, raster, "Lane", UTM, UTM)
    assert sorted(tuple(r) for r in p.tiles.collect()) == [(1, 0, True, 3, 2), (1, 1, True, 4, 3), (1, 2, True, 0, 0)]
    merged = {(json.loads(r["props"])["Id"], r["id"]): ([(q["x"], q["y"]) for q in r["line"]], r["n_parts"]) for r in p.merged.collect()}
    assert merged["a", 0] == ([(500.0, 100.0), (670.0, 100.0), (900.0, 100.0)], 2)
    assert {k[0] for k in merged} == {"a", "b", "d"} and merged["d", 2][1] == 2
    assert sorted(json.loads(r["props"])["Id"] for r in p.final.collect()) == ["a", "b", "d"]
    told = [(r["tile_index"], json.loads(r["props"])["Id"], [(q["x"], q["y"]) for q in r["line"]]) for r in p.state.collect()]
    assert (1, "a", [(576.0, 100.0), (670.0, 100.0)]) in told and all(k in (1, 2) for k, _, _ in told)
    noise = jobs.parsed(spark.createDataFrame([(1, 0, "no"), (1, 1, None), (1, 2, '{"a": 1}')], "sample_id long, tile_index long, text string"), "Lane")
    assert [r["decoded_ok"] for r in noise.orderBy("tile_index").collect()] == [False, True, False]


def test_duplicates_and_evaluation(spark):
    line = lambda y, n=3: [(10.0 * k, float(y)) for k in range(n)]
    raster = spark.createDataFrame([(s, 1.0, 0.0, 1.0, 0.0) for s in (1, 2, 3)], "sample_id long, a double, c double, e double, f double")
    rows = [(1, 0, '{"w": 1.0}', line(0)), (1, 1, '{"w": 1}', line(0.5)), (1, 2, '{"w": 2}', line(0)), (1, 3, '{"w": 1}', line(0.2, 4)), (1, 4, '{"w": 1}', [(1.0, 1.0)]), (2, 0, "{}", line(0)), (2, 1, "{}", []), (3, 7, "{}", [(1.0, 1.0)])]
    df = spark.createDataFrame(rows, f"sample_id long, id long, props string, line {KIND}")
    assert sorted((r["sample_id"], r["id"]) for r in jobs.dedup_lines(df, raster, 1.0).collect()) == [(1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (3, 7)]
    gt = spark.createDataFrame([(1, 0, '{"w": 1}', line(0)), (1, 1, '{"w": 5}', line(50)), (2, 0, "{}", line(0))], f"sample_id long, id long, props string, line {KIND}")
    tile = spark.createDataFrame([(1, True, 1), (1, False, 0)], "sample_id long, decoded_ok boolean, n_features long")
    out = {r["sample_id"]: r for r in jobs.evaluate(df.where("sample_id = 1"), gt, raster, tile, 2.0).collect()}
    assert set(out) == {1, 2} and out[1]["pred_count"] == 4 and out[1]["gt_count"] == 2 and out[1]["property_acc"] == 1 and out[1]["mean_hausdorff"] == 0 and out[1]["parse_ok_rate"] == 0.5
    assert out[2]["recall"] == 0 and out[2]["mean_hausdorff"] == math.inf and out[2]["parse_ok_rate"] == 0
    told = {r["name"]: r["mean"] for r in jobs.report(jobs.evaluate(df.where("sample_id = 1"), gt, raster, tile, 2.0)).collect()}
    assert told["mean_hausdorff"] == 0 and told["recall"] == 0.25 and told["parse_success_rate"] == 0.25
    flat = spark.createDataFrame([(1, [(1.0, math.nan), (2.0, 2.0)]), (1, line(3))], f"sample_id long, line {KIND}")
    assert prepare.to_world(flat, raster).count() == 1
    assert df.select(L.any_inside(F.col("line"), F.lit(0), F.lit(0), F.lit(1), F.lit(1))).count() == 8


def test_equal_copies_keep_the_last(spark):
    """In world coordinates these two lengths, equal in pixels, were rounded to different sides."""
    raster = spark.createDataFrame([(1, 0.2, 469000.0, -0.2, 4438500.0)], "sample_id long, a double, c double, e double, f double")
    line = [(920, 521), (932, 535), (971, 523), (990, 509), (1004, 515), (1032, 506), (1044, 520), (1075, 540), (1111, 540), (1137, 539)]
    rows = [(1, i, "{}", [(float(x + d), float(y + d * 3 / 4)) for x, y in line]) for i, d in ((0, 0), (1, 4))]
    df = spark.createDataFrame(rows, f"sample_id long, id long, props string, line {KIND}")
    assert [r["id"] for r in jobs.dedup_lines(df, raster, 1.1).collect()] == [1]
    wide = df.withColumn("rings", F.array(F.concat("line", F.reverse(F.transform("line", lambda p: L.point(p["x"], p["y"] + 40))))))
    wide = wide.withColumn("line", F.col("rings")[0])
    assert [r["id"] for r in jobs.dedup_areas(wide, raster, 0.5).collect()] == [1]


def test_answers_in_parts(spark):
    """Answers in parts, cut anywhere, are read as whole ones are, and of plain ones no more is held than what is not yet read."""
    import tracemalloc

    from vectorloom.functions import props as P
    from vectorloom.operators.rounds import Steps

    one = lambda k: json.dumps({"type": "Feature", "properties": {"Id": k, "t": "} ]{é"}, "geometry": {"type": "LineString", "coordinates": [[k, 1.5, 0.0], [k, -2e3, 0]]}}, ensure_ascii=False)
    few = ",".join(one(k) for k in range(3))
    texts = [f'Say: {{"type": "FeatureCollection ", "features":[{few}, 5, null], "n": 1}} {{', f'{{"type":"FeatureCollection","features":["{{}}",{few}]}}', f'{{"features":[{few}],"x":{{}}}}', f"{{cut: {one(1)}", f'{{"type":"FeatureCollection","features":[{few}', f'{{"type":"FeatureCollection","features":[{few},{{"v":NaN}}]}}',
             f'{{"type":"FeatureCollection","features":[{few}],"features":[]}}', '{"type":"FeatureCollection","features":[]}', "", "  ", "no", '{"a": 1}', one(7), "{", f'{{"type":"FeatureCollection","features":[{few}],"n":{"9" * 40}}}']
    told = lambda read, found: (sorted(tuple(r) for r in read.collect()), sorted((r["tile_index"], r["source_index"], *([json.dumps(json.loads(r["feature"]), sort_keys=True)])) for r in found.collect()))
    whole = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "sample_id long, tile_index long, text string")
    parsed = jobs.parsed(whole, "Lane")
    from vectorloom.sources import geojson

    want = told(parsed.select("sample_id", "tile_index", "decoded_ok"), geojson.elements(parsed.where("found is not null").select("sample_id", "tile_index", F.col("found").alias("text"))).where("feature like '{%'"))
    assert len(want[1]) > 12 and want == told(*(x if n == 0 else x.where("feature like '{%'") for n, x in enumerate(jobs.answered(whole, "Lane", Steps(spark)))))
    cut = spark.createDataFrame([(1, k, i, t[i : i + 3]) for k, t in enumerate(texts) for i in range(0, max(len(t), 1), 3)], "sample_id long, tile_index long, part long, text string")
    assert want == told(*(x if n == 0 else x.where("feature like '{%'") for n, x in enumerate(jobs.answered(cut, "Lane", Steps(spark)))))
    rows = spark.createDataFrame([(1, k, f'{{"Id":{k % 3}}}', [(float(k), 1.0), (2.0, k / 7)], 0.2, 5.0, -0.2, 7.0) for k in range(7)], f"s long, id long, props string, line {KIND}, a double, c double, e double, f double")
    parts = geojson.emit_parts(rows, ["s"], "Lane", "linestring", "EPSG:32650", "EPSG:32650").orderBy("part").collect()
    assert "".join(r["text"] for r in parts) == geojson.emit(rows, ["s"], "Lane", "linestring", "EPSG:32650", "EPSG:32650").first()["geojson"] and [r["last"] for r in parts] == [False] * 6 + [True]
    answer, n = P.Answer(), 0
    tracemalloc.start()
    answer.feed('{"type":"FeatureCollection","features":[')
    for k in range(20_000):
        n += len(answer.feed(("," if k else "") + one(k)))
    n += len(answer.feed("]")) + len(answer.feed("} end"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and answer.settled and peak < 200_000
