"""TIFF, GeoJSON, configuration and tables from files written here."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.sources import config, geojson, tables, tiff


def write_tiff(pixels, compress=False, rows=3):
    """A striped, chunky, little-endian file with one pixel scale and tie point."""
    h, w, n = pixels.shape
    strips = [pixels[y : y + rows].tobytes() for y in range(0, h, rows)]
    strips = [zlib.compress(s) for s in strips] if compress else strips
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [8] * n), 259: (3, [8 if compress else 1]), 273: (4, None), 277: (3, [n]), 278: (4, [rows]), 279: (4, [len(s) for s in strips]), 33550: (12, [0.2, 0.2, 0.0]), 33922: (12, [0, 0, 0, 468000.0, 4438000.0, 0]), 34735: (3, [1, 1, 0, 1, 3072, 0, 1, 32650])}
    at = 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", []
    data_at = at + sum(len(struct.pack("<" + {3: "H", 4: "I", 12: "d"}[k] * (len(strips) if v is None else len(v)), *([0] * len(strips) if v is None else v))) for k, v in tags.values())
    offsets = [data_at + sum(len(s) for s in strips[:i]) for i in range(len(strips))]
    for tag, (kind, v) in tags.items():
        v = offsets if v is None else v
        raw = struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(v), *v)
        if len(raw) <= 4:
            entries.append(struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, kind, len(v), at + len(extra)))
            extra += raw
    body = struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + b"".join(entries) + b"\0\0\0\0" + extra
    return body.ljust(data_at, b"\0") + b"".join(strips)


@pytest.mark.parametrize("compress", [False, True])
def test_tiff(spark, tmp_path, compress):
    px = np.random.default_rng(1).integers(0, 255, (7, 5, 3), np.uint8)
    (tmp_path / "0.tif").write_bytes(write_tiff(px, compress))
    t = tiff.Tiff((tmp_path / "0.tif").read_bytes())
    assert (t.read([1, 2, 3]) == px).all() and (t.read([3, 1], (1, 2, 4, 6)) == px[2:6, 1:4][:, :, [2, 0]]).all()
    df = tiff.files(spark, str(tmp_path / "0.tif"))
    m = tiff.raster_meta(df).first()
    assert (m["width"], m["height"], m["bands"], m["crs"], m["a"], m["e"], m["c"], m["f"]) == (5, 7, 3, "EPSG:32650", 0.2, -0.2, 468000.0, 4438000.0)
    on = np.zeros((7, 5), bool)
    for r in tiff.mask_runs(df).collect():
        on[r["y"], r["x0"] : r["x1"]] = True
    assert (on == (px[:, :, 0] > 127)).all()
    with pytest.raises(config.CodedError):
        tiff.Tiff(b"no tiff")


def lzw(data):
    """TIFF's LZW, bit by bit."""
    bits, width = "", 9
    table, word = {bytes([i]): i for i in range(256)}, b""
    bits += format(256, f"0{width}b")
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        bits += format(table[word], f"0{width}b")
        table[word + bytes([c])] = len(table) + 2
        if len(table) + 2 in (512, 1024, 2048):
            width += 1
        word = bytes([c])
        if len(table) + 2 >= 4094:
            bits += format(table[word], f"0{width}b") + format(256, f"0{width}b")
            table, word, width = {bytes([i]): i for i in range(256)}, b"", 9
    bits += (format(table[word], f"0{width}b") if word else "") + format(257, f"0{width}b")
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_lzw_and_floats_and_big_files():
    import random

    r = random.Random(1)
    for data in (b"", b"a", b"ab" * 4000, bytes(r.choice(b"abc") for _ in range(30000)), bytes(r.randrange(256) for _ in range(9000))):
        assert tiff._lzw(lzw(data)) == data
    px = np.random.default_rng(1).normal(size=(4, 3)).astype("<f4")
    raw = px.tobytes()
    tags = [(256, 3, 3), (257, 3, 4), (258, 3, 32), (259, 3, 1), (273, 16, 0), (277, 3, 1), (278, 3, 4), (279, 16, len(raw)), (339, 3, 3)]
    at = 16 + 8 + 20 * len(tags) + 8
    body = b"".join(struct.pack("<HHQQ", t, k, 1, at if t == 273 else v) for t, k, v in tags)
    t = tiff.Tiff(struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(tags)) + body + b"\0" * 8 + raw)
    assert t.meta["dtype"] == "float32" and (t.read([1])[:, :, 0] == px).all()


def test_windows_and_png(spark, tmp_path):
    from vectorloom.functions import images

    px = np.random.default_rng(2).integers(0, 255, (7, 5, 3), np.uint8)
    (tmp_path / "0.tif").write_bytes(write_tiff(px))
    df = tiff.files(spark, str(tmp_path / "0.tif"))
    path = df.first()["path"]
    boxes = spark.createDataFrame([(path, 0, 0, 0, 5, 7), (path, 1, 2, 3, 9, 9)], "path string, tile_index long, x0 long, y0 long, x1 long, y1 long")
    got = {r["tile_index"]: np.frombuffer(r["pixels"], "<f4").reshape(r["height"], r["width"], 3) for r in tiff.windows(df, boxes, [3, 2, 1]).collect()}
    assert (got[0] == px[:, :, ::-1]).all() and (got[1] == px[3:, 2:, ::-1]).all()
    for data, back in ((images.png(px), px), (images.png(np.moveaxis(px, -1, 0) / 255.0, True), px)):
        at = data.index(b"IDAT")
        rows = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
        assert abs(np.frombuffer(rows, np.uint8).reshape(7, 16)[:, 1:].reshape(7, 5, 3).astype(int) - back).max() <= 1


def test_exports(spark, tmp_path):
    from vectorloom.sources import exports

    assert exports.settings({}) == exports.Exports() and exports.settings({"artifact_export": {"enabled": "yes", "max_samples_per_batch": "3"}}).max_samples_per_batch == 3
    tile = spark.createDataFrame([("s", i, i % 2 == 0, "r", 0, 0, 9, 9, 0, 0, 9, 9, 0.5, 40) for i in range(5)], "sample_id string, candidate_index long, selected boolean, reason string, x0 long, y0 long, x1 long, y1 long, keep_x0 long, keep_y0 long, keep_x1 long, keep_y1 long, mask_ratio double, mask_pixels long")
    told = json.loads(exports.audit(tile).first()["text"])
    assert [t["candidate_index"] for t in told] == list(range(5)) and told[0]["bbox"] == [0, 0, 9, 9]
    assert [r["folder"] for r in exports.patches(tile, exports.Exports(max_patch_images_per_sample=3)).orderBy("candidate_index").collect()] == ["selected", "discarded", "selected"]
    assert exports.patches(tile, exports.Exports(save_kept_patches=False)).count() == 2
    said = spark.createDataFrame([("s", 0, "raw é", None), ("s", 1, None, "{}")], "sample_id string, tile_index long, text string, found string")
    fc = spark.createDataFrame([("s", 1, "kept", '{"b":1,"a":"é"}'), ("s", 0, "pred", None)], "sample_id string, tile_index long, kind string, geojson string")
    rows = exports.tile_files(said, fc, "lane").unionByName(exports.failures(said)).unionByName(exports.sample_files(fc.where("tile_index = 1").drop("tile_index"), "Lane"))
    assert sorted(r["artifact"] for r in rows.collect()) == ["Lane.kept.geojson", "tile_0000.pred.parse_failed.json", "tile_geojson/lane/tile_0000.pred.raw.txt", "tile_geojson/lane/tile_0001.kept.geojson", "tile_geojson/lane/tile_0001.pred.raw.txt"]
    exports.write(rows, str(tmp_path / "out"))
    back = {r["artifact"]: r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert len(back) == 5 and json.loads(back["Lane.kept.geojson"]) == {"b": 1, "a": "é"} and back["Lane.kept.geojson"].startswith('{\n  "b": 1')
    items = spark.createDataFrame([("s", "lane", b, p, "q", "st", "t", "m", "[]", None) for b in range(2) for p in range(2)], "sample_id string, task string, batch long, place long, prompt string, state string, target string, target_meta string, state_items string, target_items string")
    assert exports.batch_files(items, exports.Exports(), "train").count() == 0
    assert {r["artifact"].rsplit("/", 1)[0] for r in exports.batch_files(items, exports.Exports(enabled=True), "train").collect()} == {"00001/00_s_lane"}


def test_inputs_and_labels(spark):
    paths = ["/d/val/a/patch_tif/0.tif", "/d/val/b/other.tif", "/d/val/b/label_check_crop/Lane.geojson", "/d/val/a/label_check_crop/Lane.geojson", "/x/2.tif", "/x/1.tif", "/x/y/3.tif", "/x/1.png"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    name = lambda d: [r["sample_id"] for r in d.collect()]
    assert name(tables.inputs(df, image="/q/z.w.tif")) == ["z.w"] and name(tables.inputs(df, folder="/x/")) == ["1", "2"] and name(tables.inputs(df, folder="/x", pattern="1.*")) == ["1", "1"]
    assert name(tables.inputs(df, root="/d", splits=(None, "test", "val"))) == ["a"]
    with pytest.raises(config.CodedError):
        tables.inputs(df, root="/d", splits=("test",))
    found = tables.samples(df, cut_first=False)
    assert [tuple(r) for r in tables.labelled(found, {"lane": "label_check_crop/Lane.geojson", "x": "label_check_crop/No.geojson"}).collect()] == [("val", "a", "lane")]


def test_geojson_polygons_and_wrong_types(spark):
    ring = [[116.63, 40.078], [116.631, 40.078], [116.631, 40.079], [116.63, 40.078]]
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"Id": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": None, "geometry": {"type": "Polygon", "coordinates": ring}}, {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": ring}}]}
    df = spark.createDataFrame([(1, json.dumps(fc), 0.2, 468000.0, -0.2, 4438000.0), (2, "no json", 0.2, 0.0, -0.2, 0.0)], "sample_id int, text string, a double, c double, e double, f double")
    got = geojson.ingest(df, "polygon", 3, "EPSG:32650").collect()
    assert [(r["sample_id"], len(r["line"]), len(r["rings"])) for r in got] == [(1, 3, 1), (1, 3, 1)]
    back = geojson.emit(geojson.ingest(df, "polygon", 3, "EPSG:32650"), ["sample_id"], "I", "polygon", "EPSG:32650").first()["geojson"]
    out = json.loads(back)["features"]
    assert len(out) == 2 and out[0]["geometry"]["coordinates"][0][1][0] == pytest.approx(116.631, abs=1e-9) and len(out[0]["geometry"]["coordinates"][0]) == 4
    assert df.select(geojson.detect_crs(F.col("text")).alias("c")).first()["c"].endswith("CRS84")


def test_config():
    assert config.expand({"a": ["${X:-1}", "${Y}", "${Z:-}"]}, {"Y": "q"}) == {"a": ["1", "q", ""]}
    assert config.expand("${NO}", {}) == "${NO}"
    assert [config.flag(v, True) for v in ("off", "", None, "maybe", "YES", False)] == [False, False, True, True, True, False]
    assert config.expand(["${A}", "${A:-d}", "x${B:-}${C:-c}y", "${1}${A}", "${", "${A:d}"], {"A": ""}) == ["", "", "xcy", "${1}", "${", "${A:d}"]
    line = {"geometry_type": "LineString", "prompt_template": " p ", "min_points_per_feature": 1}
    tasks = config.load_tasks({"tasks": {" Lane": line, "area": {"geometry_type": "polygon", "prompt_template": "q", "max_features": None}}})
    assert [(t.name, t.collection, t.prompt, t.min_points, t.max_features) for t in tasks] == [("lane", "Lane", "p", 2, 0), ("area", "area", "q", 3, 0)]
    assert [t.name for t in config.enabled(tasks, {"data": {"task_enable": {"lane": " False "}}})] == ["area"] and len(config.load_tasks({})) == 2
    for bad in (lambda: config.load_tasks({"tasks": {"p": {"geometry_type": "point"}}}), lambda: config.find_task(tasks, "q"), lambda: config.build({"data": {}}, "v", "eval"), lambda: config.load("/nowhere.yaml")):
        with pytest.raises(config.CodedError):
            bad()
    tree = {"data": {"dataset_root": "/d", "image_relpath": "i.tif", "image_size": "512", "label_relpaths": {"lane": "l", "intersection": "x"}}, "tiling": {"train": {"overlap_px": 100, "max_tiles_per_sample": 4}}}
    b = config.build(tree, "train", "train")
    assert (b.image_size, b.tiling.tile, b.tiling.keep_margin, b.tiling.max_tiles, b.tiling.min_pixels, b.filter_by_mask, b.labels["lane"]) == (512, 2048, 50, 4, 1024, True, "l")
    assert not config.build(tree, "val", "eval").filter_by_mask and not config.stage_tiling({}, "probe").on

    def stop():
        raise KeyboardInterrupt

    told = []
    assert [config.run(j, told.append) for j in (lambda: None, stop, lambda: config.find_task(tasks, "q"), lambda: 1 / 0)] == [0, 130, 1, 1] and told[1].startswith("[VL-1304]") and "cause=" in told[2]
    inner = config.CodedError("VL-1", "in")
    assert str(config.CodedError("VL-2", "out", inner)) == "[VL-1] in"
    assert config.stage_tiling({}, "train").min_ratio == 0.002 and config.stage_tiling({}, "predict").fallback


def test_tables(spark, tmp_path):
    paths = [f"/d/train/s{i}/{f}" for i in range(4) for f in ("patch_tif/0.tif", "label_check_crop/Lane.geojson") if not (i == 0 and "tif" in f)]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["sample_id"] for r in tables.samples(df, 2).collect()} == {"s1"}
    assert {r["sample_id"] for r in tables.samples(df, 2, cut_first=False).collect()} == {"s1", "s2"}
    build = lambda d: d.withColumn("v", F.col("k") * 2)
    path = str(tmp_path / "cache")
    assert tables.cached(spark.range(3).toDF("k"), "k", path, build).count() == 3
    assert tables.cached(spark.range(5).toDF("k"), "k", path, build).count() == 5
    assert tuple(tables.cache_counts(spark.range(9).toDF("k"), spark.read.parquet(*tables.Manifest(spark, path).folders()), "k").first()) == (9, 5, 4)
    tables.append_metrics(spark.createDataFrame([(1, 0.5)], "epoch long, train_loss double"), str(tmp_path / "m"))
    assert tables.read_metrics(spark, str(tmp_path / "m")).first()["train_loss"] == 0.5


def test_block_source(spark, tmp_path):
    """Blocks are planned into partitions, filters reach the plan, a window reads only its blocks, and windows come out whole."""
    from vectorloom.sources import rasters

    r = np.random.default_rng(2)
    images = {f"{n}.tif": r.integers(0, 255, (400, 300, 3)).astype(np.uint8) for n in "ab"}
    for name, px in images.items():
        (tmp_path / name).write_bytes(write_tiff(px, rows=8))
    (tmp_path / "notes.txt").write_text("no raster")
    # in this process, where reads can be counted
    reader = rasters.GeoTiffReader({"path": str(tmp_path), "bands": "1,2,3", "partitionBytes": "60000"})
    rest = list(reader.pushFilters([rasters.LessThan(("y0",), 216), rasters.GreaterThan(("y1",), 200), rasters.EqualTo(("path",), str(tmp_path / "a.tif")), rasters.EqualTo(("block",), 3)]))
    assert [f.attribute for f in rest] == [("block",)]
    parts = reader.partitions()
    assert [p.path for p in parts] == [str(tmp_path / "a.tif")] and [b[0] for b in parts[0].blocks] == [25, 26]
    opened = []
    ranges = rasters.Ranges
    try:
        rasters.Ranges = lambda path: opened.append(ranges(path)) or opened[-1]
        assert len(list(reader.read(parts[0]))) == 2
    finally:
        rasters.Ranges = ranges
    assert opened[0].fetched <= rasters.HEAD + 2 * 8 * 300 * 3 < 400 * 300 * 3
    whole = rasters.GeoTiffReader({"path": str(tmp_path), "partitionBytes": "60000"}).partitions()
    assert len(whole) > 10 and sum(len(p.blocks) for p in whole) == 100
    # as Spark reads it
    spark.dataSource.register(rasters.GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("geotiff").option("bands", "3,1").option("partitionBytes", "60000").load(str(tmp_path))
    assert df.count() == 100 and df.where("y0 < 16").count() == 4 and df.where("block = 3 and y0 < 100").count() == 2
    boxes = [(str(tmp_path / n), k, *b) for n in images for k, b in enumerate([(0, 0, 300, 400), (17, 5, 60, 77), (299, 399, 300, 400)])]
    tiles = spark.createDataFrame(boxes, "path string, tile_index long, x0 long, y0 long, x1 long, y1 long")
    got = {(g["path"], g["tile_index"]): np.frombuffer(g["pixels"], "<f4").reshape(g["height"], g["width"], 2) for g in rasters.windows(df, tiles, 2).collect()}
    assert len(got) == 6
    for path, k, x0, y0, x1, y1 in boxes:
        assert (got[path, k] == images[path.split("/")[-1]][y0:y1, x0:x1][:, :, [2, 0]]).all()


def test_two_writers_build_each_key_once(spark, tmp_path):
    """A second writer adds the same and further keys while the first one builds; a third one only reads."""
    path, built = str(tmp_path / "cache"), []

    def build(df, name):
        built.append((name, sorted(r["k"] for r in df.collect())))
        return df.withColumn("by", F.lit(name))

    def slow(df):
        if not built:
            tables.cached(spark.range(3, 9).toDF("k"), "k", path, lambda x: build(x, "second"))
        return build(df, "first")

    first = tables.cached(spark.range(6).toDF("k"), "k", path, slow)
    assert {(r["k"], r["by"]) for r in first.collect()} == {(k, "first" if k < 3 else "second") for k in range(6)} and first.count() == 6
    every = tables.cached(spark.range(9).union(spark.range(4)).toDF("k"), "k", path, lambda x: build(x, "third"))
    assert every.count() == 9 and [n for n, _ in built] == ["second", "first"]
    assert len(tables.Manifest(spark, path).folders()) == 2
    assert tables.cached(spark.range(0).toDF("k"), "k", str(tmp_path / "none"), lambda x: x.withColumn("by", F.lit("x"))).count() == 0
