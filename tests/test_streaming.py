"""Merging by components and ranked lists, against first fit in plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from vectorloom.functions import lines as L
from vectorloom.functions import props as P
from vectorloom.streaming import tiled

SCHEMA = "sample_id long, tile_index long, feature_id long, props string, pts array<array<double>>"


def merged_plain(features, tolerance=3.0):
    """First fit over all lines, every pair of ends by name: properties, points, number of parts."""
    out = []
    for props, new in features:
        for k, (known, old, n) in enumerate(out):
            if len(old) < 2 or len(new) < 2:
                continue
            ends = {"end-start": math.dist(old[-1], new[0]), "end-end": math.dist(old[-1], new[-1]), "start-end": math.dist(old[0], new[-1]), "start-start": math.dist(old[0], new[0])}
            best = min(ends, key=ends.get)
            if P.equal(known, props) and ends[best] <= tolerance:
                back = list(reversed(new))
                out[k] = known, {"end-start": old + new[1:], "end-end": old + back[1:], "start-end": new[:-1] + old, "start-start": back[:-1] + old}[best], n + 1
                break
        else:
            out.append((props, new, 1))
    return out


def frame(spark, rows):
    df = spark.createDataFrame([(k, t, f, json.dumps(p), [list(map(float, v)) for v in x]) for k, t, f, p, x in rows], SCHEMA)
    return df.withColumn("line", F.transform("pts", lambda p: L.point(p[0], p[1]))).drop("pts")


def plain(rows):
    """By sample, what is merged in the order of tiles."""
    out = {}
    for k in {r[0] for r in rows}:
        out[k] = [(P.canonical(p), [tuple(map(float, v)) for v in x], n) for p, x, n in merged_plain([(p, x) for _, _, _, p, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])])]
    return out


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        out.setdefault(r["sample_id"], []).append((r["props"], [(p["x"], p["y"]) for p in r["line"]], r["n_parts"]))
    return out


def roads(r, n):
    """Long roads cut into lines that arrive in any order and either way round, and some that branch or close."""
    rows = []
    for road in range(n):
        x, y = r.randint(0, 4000), 60 * road
        pieces = []
        for _ in range(r.randint(1, 14)):
            line = [(x + 10 * k, y + r.choice((0, 1))) for k in range(r.randint(2, 4))]
            x = line[-1][0] + r.choice((0, 0, 1, 2, 3, 4))
            pieces.append(line)
            y = line[-1][1]
        rows += [({"road": road % 3, "w": 1.5}, p if r.random() < 0.6 else p[::-1]) for p in pieces]
    rows += [({"ring": 1}, [(0, 9000), (50, 9000)]), ({"ring": 1}, [(50, 9000), (50, 9050)]), ({"ring": 1}, [(50, 9050), (0, 9000)])]
    rows += [({"fork": 1}, [(0, 9500), (50, 9500)])] + [({"fork": 1}, [(50, 9500), (90, 9400 + 60 * k)]) for k in range(3)]
    rows += [({"near": 1 + k * 6e-7}, [(10 * k, 9900), (10 * k + 10, 9900)]) for k in range(4)] + [({"point": 1}, [(5, 9950)]), ({"point": 1}, [(5, 9950), (9, 9950)]), ({"nan": math.nan}, [(0, 9980), (9, 9980)]), ({"nan": math.nan}, [(9, 9980), (20, 9980)])]
    r.shuffle(rows)
    return rows


def test_fold_against_first_fit(spark):
    r = random.Random(4)
    kinds = [{"a": 1}, {"a": 1.0000001}, {"a": True}, {"a": "x"}, {"a": None}, {"a": "1"}, {"b": 1}]
    rows = []
    for k in range(12):  # crowded: everything meets everything
        for f in range(25):
            rows.append((k, r.randint(0, 6), f, r.choice(kinds), [(r.randint(0, 14), r.randint(0, 14)) for _ in range(r.randint(2, 4))]))
    for k in range(20, 24):
        for f, (p, line) in enumerate(roads(r, 25)):
            rows.append((k, r.randint(0, 9), f, p, line))
    got = tiled.fold(frame(spark, rows), ["sample_id"]).where("tile_index is null").collect()
    assert told(got) == plain(rows)
    assert [r["n_parts"] for r in tiled.fold(frame(spark, rows[:9]), ["sample_id"], joins=False).collect()] == [1] * 9
    assert tiled.fold(frame(spark, rows).limit(0), ["sample_id"]).count() == 0


def test_runs_need_no_fold(spark, monkeypatch):
    """Long plain chains are ranked, not folded."""
    monkeypatch.setattr(tiled.Ends, "add", None)
    r = random.Random(8)
    order = list(range(90))
    r.shuffle(order)
    rows = [(1, t, i, {"a": 1}, [(10 * i, 0), (10 * i + 10, 0)] if i % 3 else [(10 * i + 10, 0), (10 * i, 0)]) for i, t in enumerate(order)]
    assert told(tiled.fold(frame(spark, rows), ["sample_id"]).collect()) == plain(rows)


def test_memory_when_a_tile_begins(spark):
    r = random.Random(5)
    rows = [(k, r.randint(0, 9), f, p, line) for k in (1, 2) for f, (p, line) in enumerate(roads(r, 12))]
    asks = [(k, t, x, y, x + 900, y + 400) for k in (1, 2) for t, (x, y) in enumerate((r.randint(0, 3000), r.randint(0, 900)) for _ in range(10))]
    tiles = spark.createDataFrame(asks, "sample_id long, tile_index long, x0 long, y0 long, x1 long, y1 long")
    got = tiled.fold(frame(spark, rows), ["sample_id"], tiles=tiles).where("tile_index is not null").collect()
    for k, t, x0, y0, x1, y1 in asks:
        before = plain([q for q in rows if q[0] == k and q[1] < t]).get(k, [])
        meets = lambda line: max(p[0] for p in line) >= x0 and min(p[0] for p in line) < x1 and max(p[1] for p in line) >= y0 and min(p[1] for p in line) < y1  # noqa: B023, E731
        assert told([g for g in got if g["sample_id"] == k and g["tile_index"] == t]).get(k, []) == [f for f in before if meets(f[1])]


@pytest.fixture
def rocks(spark):
    from vectorloom.streaming.ordered import ROCKS

    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.unset(name)


def streamed(spark, folder, groups, patience="1 hour", lateness="1 hour"):
    """Parts of tiles (sample, index, seconds, [(feature, props, line)]) that come group by group."""
    from vectorloom.streaming.ordered import merge_stream

    import datetime

    schema = "sample_id long, tile_index long, ts timestamp, features array<struct<feature_id:long,props:string,line:array<struct<x:double,y:double>>>>"
    for n, group in enumerate(groups):
        at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
        rows = [(k, t, at(s), [(f, json.dumps(p), [(float(x), float(y)) for x, y in line]) for f, p, line in fs]) for k, t, s, fs in group]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{n:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = merge_stream(source, "sample_id", patience=patience, lateness=lateness).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())


def test_stream_restores_scan_order(spark, rocks, tmp_path):
    """Tiles shuffled over triggers give the batch's parts."""
    r = random.Random(9)
    lines = [(k, r.randint(0, 7), f, p, line) for k in (1, 2) for f, (p, line) in enumerate(roads(r, 8)) if not any(v != v for v in p.values())]
    tiles = [(k, t, t, sorted(((f, p, line) for q, u, f, p, line in lines if (q, u) == (k, t)), key=lambda x: x[0])) for k in (1, 2) for t in range(8)]
    r.shuffle(tiles)
    got = streamed(spark, str(tmp_path), [tiles[i : i + 3] for i in range(0, len(tiles), 3)])
    rows = frame(spark, lines)
    rows = rows.select("sample_id", F.struct(F.col("tile_index").alias("tile"), F.col("feature_id").alias("feature")).alias("id"), P.canonical_udf("props").alias("props"), "line").withColumn("bucket", tiled._bucket_udf("props"))
    from vectorloom.operators.rounds import Steps

    want = tiled.parts(rows, ["sample_id"], 3.0, Steps(spark)).collect()
    assert got == sorted((w["sample_id"], *w["id"], *w["founder"], w["at"], w["flip"], False) for w in want)


def test_stream_goes_on_without_a_lost_tile(spark, rocks, tmp_path):
    one = lambda i: [(i, {"a": 1}, [(10 * i, 0), (10 * i + 10, 0)])]
    groups = [[(1, 0, 0, one(0))], [(1, 2, 1, one(1))], [(2, 0, 500, [])], [(2, 1, 1000, [])], [(1, 1, 1001, one(7))]]
    got = streamed(spark, str(tmp_path), groups, patience="60 seconds", lateness="1 second")
    assert got == [(1, 0, 0, 0, 0, 0, False, False), (1, 1, 7, 1, 7, 0, False, True), (1, 2, 1, 0, 0, 1, False, False)]
