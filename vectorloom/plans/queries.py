"""Queries over the driver's tables, each applying an operator to a whole fixture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import lines as L
from ..functions import polygons, props
from ..operators import match, metrics, pieces, synthesis, tiles
from .fixtures import view

TILE, OVERLAP, MARGIN = 768, 192, 96


def _r(x: Column, n: int = 6) -> Column:
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    return F.round(x, n) + F.lit(0.0)


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _int(c: str) -> Column:
    return F.col(c).cast("int").alias(c)


def _tiles(s: SparkSession, d: str) -> DataFrame:
    return tiles.generate(view(s, d, "fx_raster"), TILE, OVERLAP, MARGIN)


def _stats(s: SparkSession, d: str) -> DataFrame:
    return tiles.mask_stats(_tiles(s, d), view(s, d, "fx_mask"))


def _audit(s: SparkSession, d: str) -> DataFrame:
    return tiles.audit(_stats(s, d), 0.3, 200_000, 4)


def _lines(s: SparkSession, d: str, name: str = "fx_point", px: Column | None = None, py: Column | None = None) -> DataFrame:
    """One row a feature: sample_id, feature_id, line."""
    x, y = (F.col("px") if px is None else px), (F.col("py") if py is None else py)
    return view(s, d, name).groupBy("sample_id", "feature_id").agg(L.points(F.col("pt"), x, y).alias("line")).where(F.size("line") >= 2)


def _exploded(df: DataFrame, keys: list[str], line: str = "line", n: int = 6) -> DataFrame:
    return df.select(*keys, F.posexplode(line).alias("i", "p")).select(*keys, F.col("i").cast("long").alias("i"), _r(F.col("p.x"), n).alias("x"), _r(F.col("p.y"), n).alias("y"))


def tile_windows(s, d):
    return _tiles(s, d)


def mask_bbox(s, d):
    return _long(tiles.mask_box(view(s, d, "fx_mask")), "x0", "y0", "x1", "y1")


def tile_mask_stats(s, d):
    return _stats(s, d).select("sample_id", "candidate_index", "mask_pixels", _r(F.col("mask_ratio")).alias("mask_ratio"))


def tile_select_audit(s, d):
    return _audit(s, d).select("sample_id", "candidate_index", "x0", "y0", "x1", "y1", "mask_pixels", _r(F.col("mask_ratio")).alias("mask_ratio"), "selected", "reason")


def tile_neighbors(s, d):
    return tiles.scan_order(_tiles(s, d)).select("sample_id", "x0", "y0", "tile_index", "tile_count", "has_left", "has_top")


def tile_state_regions(s, d):
    t = tiles.state_regions(tiles.scan_order(_tiles(s, d)), 128)
    return t.select("sample_id", "tile_index", _int("strip"), "sx0", "sy0", "sx1", "sy1")


def _envelopes(s, d) -> DataFrame:
    return view(s, d, "fx_point").groupBy("sample_id", "feature_id").agg(F.min("px").alias("rx0"), F.min("py").alias("ry0"), F.max("px").alias("rx1"), F.max("py").alias("ry1"))


def feature_envelope_join(s, d):
    return tiles.features_in_tiles(_tiles(s, d), _envelopes(s, d)).select("sample_id", "candidate_index", "feature_id")


def empty_tile_filter(s, d):
    return tiles.without_empty(_tiles(s, d), _envelopes(s, d)).select("sample_id", "candidate_index", "x0", "y0")


def work_items(s, d):
    labels = _envelopes(s, d).select("sample_id", F.lit("lane").alias("task")).distinct().union(view(s, d, "fx_box").select("sample_id", F.lit("intersection")).distinct())
    tasks = s.createDataFrame([("lane", 0), ("intersection", 1)], "task string, task_order int")
    return tiles.items(view(s, d, "fx_raster").select("sample_id"), tasks, tiles.scan_order(_tiles(s, d)).select("sample_id", "tile_index", "tile_count"), labels).select("sample_id", "task", "task_order", "tile_index", "tile_count")


def keep_center_filter(s, d):
    box = _tiles(s, d).select("sample_id", "candidate_index", "keep_x0", "keep_y0", "keep_x1", "keep_y1")
    near = tiles.features_in_tiles(_tiles(s, d), _envelopes(s, d)).select("sample_id", "candidate_index", "feature_id")
    rows = near.join(box, ["sample_id", "candidate_index"]).join(_lines(s, d), ["sample_id", "feature_id"])
    return pieces.keep_centered(rows, [F.col(f"keep_{c}") for c in ("x0", "y0", "x1", "y1")]).select("sample_id", "candidate_index", "feature_id")


def _hits(s, d) -> DataFrame:
    size = view(s, d, "fx_raster").select("sample_id", "width", "height")
    return pieces.vertex_hits(view(s, d, "fx_point").join(size, "sample_id"), view(s, d, "fx_mask"))


def mask_inside_ratio(s, d):
    return pieces.inside_ratio(_hits(s, d), ["sample_id", "feature_id"]).select("sample_id", "feature_id", "n_points", "n_inside", _r(F.col("ratio")).alias("ratio"), "ok", "partial")


def line_mask_islands(s, d):
    return pieces.trusted_runs(_hits(s, d), ["sample_id", "feature_id"])


def _with_raster(s, d, df: DataFrame) -> DataFrame:
    return df.join(view(s, d, "fx_raster"), "sample_id")


def _affine() -> list[Column]:
    return [F.col("a"), F.lit(0.0), F.col("c"), F.lit(0.0), F.col("e"), F.col("f")]


def affine_world(s, d):
    p = _with_raster(s, d, view(s, d, "fx_point"))
    x, y = C.pixel_to_world(F.col("px"), F.col("py"), _affine())
    bx, by = C.world_to_pixel(x, y, _affine())
    return p.select("sample_id", "feature_id", "pt", _r(x).alias("wx"), _r(y).alias("wy"), _r(bx, 4).alias("bx"), _r(by, 4).alias("by"))


def utm_roundtrip(s, d):
    p = view(s, d, "fx_point")
    lon, lat = F.col("px") * 0.001 + 116.0, F.col("py") * 0.001 + 39.0
    e, n = C.project(lon, lat, "EPSG:4326", "EPSG:32650")
    blon, blat = C.project(e, n, "EPSG:32650", "OGC:CRS84")
    return p.select("sample_id", "feature_id", "pt", _r(e, 4).alias("east"), _r(n, 4).alias("north"), _r(blon, 7).alias("lon"), _r(blat, 7).alias("lat"))


def letterbox_uv(s, d):
    t = _tiles(s, d)
    box = C.letterbox(F.col("width"), F.col("height"), F.lit(256), [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    u, v = C.to_uv(F.col("x0") + 17, F.col("y0") + 33, F.col("box"))
    x, y = C.from_uv(u, v, F.col("box"))
    return t.withColumn("box", box).select("sample_id", "candidate_index", F.col("box.resized_w").alias("resized_w"), F.col("box.resized_h").alias("resized_h"), F.col("box.pad_x").alias("pad_x"), F.col("box.pad_y").alias("pad_y"), _r(u).alias("u"), _r(v).alias("v"), _r(x).alias("x"), _r(y).alias("y"))


def quantise_bins(s, d):
    p = view(s, d, "fx_point")
    u = F.col("px") * 0.17
    q = C.quantise(u, 256, 640)
    return p.select("sample_id", "feature_id", "pt", q.alias("q"), _r(C.dequantise(q, 256, 640)).alias("u"))


def resample_polyline(s, d):
    out = _lines(s, d).withColumn("r", L.resample(F.col("line"), 30.0, F.greatest(F.lit(4), F.size("line") * 2)))
    return _exploded(out, ["sample_id", "feature_id"], "r", 5)



def boundary_side(s, d):
    p = view(s, d, "fx_point").select("sample_id", "feature_id", "pt", F.pmod("px", F.lit(256)).alias("u"), F.pmod("py", F.lit(256)).alias("v"))
    return p.select("sample_id", "feature_id", "pt", L.boundary_side(L.point(F.col("u"), F.col("v")), 256, 1.5).alias("side"))


def _mod_lines(s, d) -> DataFrame:
    return _lines(s, d, px=F.pmod("px", F.lit(256)), py=F.pmod("py", F.lit(256)))


def canonical_line(s, d):
    return _exploded(_mod_lines(s, d).withColumn("line", L.canonical_line(F.col("line"), 256)), ["sample_id", "feature_id"])


def canonical_ring(s, d):
    return _exploded(_mod_lines(s, d).withColumn("line", L.canonical_ring(F.col("line"))), ["sample_id", "feature_id"])


def anchors(s, d):
    out = _mod_lines(s, d).withColumn("side", F.explode(L.boundary_sides(F.col("line"), 256))).where(F.col("side").isin("left", "top"))
    return _exploded(out.withColumn("line", L.anchors(L.canonical_line(F.col("line"), 256), 3)), ["sample_id", "feature_id", "side"])


def target_items(s, d):
    rows = _mod_lines(s, d).withColumn("cut_start", F.col("feature_id") % 3 == 0).withColumn("cut_end", F.col("feature_id") % 2 == 0)
    return pieces.targets(rows, 256).select("sample_id", "feature_id", "cut_in", "cut_out", "source")


_BOX = (200.0, 150.0, 1000.0, 800.0)


def line_clip_bbox(s, d):
    out = _lines(s, d).withColumn("parts", pieces.clip_line(F.col("line"), *(F.lit(v) for v in _BOX)))
    rows = out.select("sample_id", "feature_id", F.posexplode("parts").alias("piece", "part"))
    return rows.select("sample_id", "feature_id", F.col("piece").cast("long").alias("piece"), F.size("part").cast("long").alias("n_points"), _r(L.length(F.col("part")), 4).alias("length"))


def cut_flags(s, d):
    src = _lines(s, d).withColumn("cut_start", F.lit(False)).withColumn("cut_end", F.lit(False))
    out = pieces.clipped(src, [F.lit(v) for v in _BOX])
    return out.select("sample_id", "feature_id", F.col("piece").cast("long").alias("piece"), "cut_start", "cut_end")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("feature_id", "id")


def hausdorff_pairs(s, d):
    both = _lines(s, d).join(_lines(s, d, "fx_pred").withColumnRenamed("line", "other"), ["sample_id", "feature_id"])
    return both.select("sample_id", "feature_id", _r(L.hausdorff(F.col("line"), F.col("other"))).alias("distance"), _r(L.endpoint_error(F.col("line"), F.col("other"))).alias("endpoint_error"))


def _matches(s, d) -> DataFrame:
    pairs = match.line_pairs(_named(_lines(s, d, "fx_pred")), _named(_lines(s, d)), ["sample_id"], 6.0)
    return match.greedy(pairs, ["sample_id"], [F.round("distance", 9), F.round("endpoint_error", 9)], carry=["distance", "endpoint_error"])


def greedy_match(s, d):
    return _matches(s, d).select("sample_id", "pred", "gt", _r(F.col("distance")).alias("distance"))


def lane_metrics(s, d):
    changed = view(s, d, "fx_pred").groupBy("sample_id", F.col("feature_id").alias("pred")).agg((F.max("prop_changed") == 0).alias("kept"))
    m = _matches(s, d).join(changed, ["sample_id", "pred"]).withColumn("same_props", F.col("kept") & (F.col("pred") == F.col("gt")))
    keys = view(s, d, "fx_raster").select("sample_id")
    out = metrics.lane_scores(keys, _lines(s, d, "fx_pred"), _lines(s, d), m, ["sample_id"])
    return out.select("sample_id", *(_r(F.when(F.abs(F.col(c)) == float("inf"), -1.0).otherwise(F.col(c))).alias(c) for c in ("precision", "recall", "f1", "mean_hausdorff", "mean_endpoint_error", "property_acc")), "pred_count", "gt_count", "unmatched_pred", "unmatched_gt")


def _boxes(s, d, shift: int = 0) -> DataFrame:
    b = view(s, d, "fx_box").select("sample_id", F.col("feature_id").alias("id"), *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))
    return b.withColumns({c: F.col(c) + F.col("id") % 7 for c in ("x0", "x1")}) if shift else b


def _box_rings(of: str = "") -> Column:
    return F.array(F.array(*(L.point(F.col(of + x), F.col(of + y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))))


def polygon_iou(s, d):
    return match.box_pairs(_boxes(s, d, 1), _boxes(s, d), ["sample_id"], 0.3).select("sample_id", "pred", "gt", _r(F.col("iou")).alias("iou"))


def polygon_iou_kernel(s, d):
    """The general kernel on the same boxes as rings; its oracle is the boxes' closed form."""
    corners = [f"{n}_{c}" for n in ("pred", "gt") for c in ("x0", "y0", "x1", "y1")]
    both = match.box_pairs(_boxes(s, d, 1), _boxes(s, d), ["sample_id"], 0.3, carry=corners)
    return both.select("sample_id", "pred", "gt", _r(polygons.iou_column(_box_rings("pred_"), _box_rings("gt_"))).alias("iou"))


def polygon_clip(s, d):
    """Boxes clipped to a box by the general kernel: pieces' areas have a closed form."""
    b = _boxes(s, d).withColumn("r", _box_rings())
    out = b.select("sample_id", "id", F.posexplode(polygons.clip_column(F.col("r"), [F.lit(v) for v in _BOX])).alias("piece", "part"))
    return out.select("sample_id", "id", F.col("piece").cast("long").alias("piece"), _r(L.area(F.col("part")[0])).alias("area"))


def polygon_metrics(s, d):
    pred, gt = _boxes(s, d, 1), _boxes(s, d)
    m = match.greedy_boxes(pred, gt, ["sample_id"], 0.3).withColumn("same_props", F.col("pred") == F.col("gt"))
    out = metrics.polygon_scores(view(s, d, "fx_raster").select("sample_id"), pred, gt, m, ["sample_id"])
    return out.select("sample_id", *(_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "mean_iou", "property_acc")), "pred_count", "gt_count")


def dedup_nms(s, d):
    return match.suppress_boxes(_boxes(s, d), ["sample_id"], 0.5)


def finite_mean(s, d):
    rows = view(s, d, "fx_point").select(F.when(F.col("feature_id") % 5 == 0, float("inf")).otherwise(F.col("px").cast("double")).alias("a"), F.when(F.col("feature_id") % 3 == 0, None).otherwise(F.col("py").cast("double")).alias("b"), F.lit(float("inf")).alias("c"))
    return metrics.finite_means(rows, ["a", "b", "c"]).select("name", _r(F.col("mean"), 4).alias("mean"))


def _decoded(s, d) -> DataFrame:
    return view(s, d, "fx_point").select("sample_id", (F.col("feature_id") % 4 != 0).alias("decoded_ok"), (F.col("feature_id") % 3).alias("n_features"))


def parse_rate(s, d):
    return metrics.parse_rates(_decoded(s, d), ["sample_id"]).withColumn("rate", _r(F.col("rate")))


def parse_success_rate(s, d):
    return metrics.success_rate(metrics.parse_rates(_decoded(s, d), ["sample_id"])).select(_r(F.col("parse_success_rate")).alias("parse_success_rate"))


def _items(s, d) -> DataFrame:
    return view(s, d, "fx_point").select("sample_id", (F.col("feature_id") % 50).alias("tile_index"), (F.col("grp") % 2).alias("task_order"), (F.col("feature_id") * 100 + F.col("pt")).alias("idx"))


def batch_plan(s, d):
    return metrics.batches(_items(s, d), 8).select("sample_id", "idx", "batch", "place")


def batch_counts(s, d):
    return metrics.batch_counts(_items(s, d), 8)


def lr_schedule(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("step"))
    return e.select("step", _r(metrics.cosine_lr(F.col("step"), 0.001, 500, 8000), 9).alias("lr"))


def _tokens(s, d) -> DataFrame:
    return view(s, d, "fx_point").select("user_id", (F.col("grp") * 10 + F.col("pt")).alias("pos"), (F.col("px") % 5).alias("predicted"), F.when(F.col("py") % 7 == 0, -100).otherwise(F.col("px") % 5).alias("label"))


def shift_accuracy(s, d):
    return metrics.shift_accuracy(_tokens(s, d), ["user_id"]).withColumn("accuracy", _r(F.col("accuracy")))


def running_best(s, d):
    rows = view(s, d, "fx_point").select("user_id", (F.col("grp") * 10 + F.col("pt")).alias("pos"), ((F.col("px") * 31 + F.col("py") * 17) % 1009).alias("loss"))
    return metrics.running_best(rows, ["user_id"], ["pos"], "loss").select("user_id", "pos", "improved", "best")


def weighted_loss(s, d):
    rows = view(s, d, "fx_point").select("sample_id", F.col("px").alias("loss"), (F.col("pt") + 1).alias("n"))
    return metrics.weighted_mean(rows, ["sample_id"], "loss", "n").select("sample_id", _r(F.col("mean_loss")).alias("mean_loss"))


def export_cap(s, d):
    return metrics.first_per(_envelopes(s, d).select("sample_id", "feature_id"), ["sample_id"], ["feature_id"], 7)


def capped_pieces(s, d):
    rows = _envelopes(s, d).select("sample_id", "feature_id", F.col("ry0").alias("raw_key"), F.col("feature_id").alias("raw_index"), F.lit(0).alias("piece"), F.lit(0).alias("strip"))
    return pieces.capped(rows, ["sample_id"], 11).select("sample_id", "feature_id")


def cache_key(s, d):
    t = tiles.scan_order(_tiles(s, d))
    box = F.concat_ws("_", *(F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")))
    left, top = F.col("has_left").cast("int"), F.col("has_top").cast("int")
    fields = [F.lit(v) for v in ("ns1", "train", "val")] + [F.col("sample_id"), F.lit("lane"), F.col("tile_index"), box] + [F.lit(v) for v in ("256", "768", "192", "96", "6.0", "127", "1")] + [left, top, F.lit("128"), F.lit("32")]
    return t.select("sample_id", "tile_index", props.cache_key(fields).alias("key"))


def prompt_meta(s, d):
    r = view(s, d, "fx_raster")
    px, world = F.lit("0,0,256,256"), F.concat_ws(",", props.fixed(F.col("c"), 1), props.fixed(F.col("f"), 1))
    return r.select("sample_id", props.geo_context(F.lit("EPSG:32650"), _affine(), px, world).alias("meta"))


def json_recover(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    noisy = F.concat(F.lit("Answer {not json: "), F.col("props"), F.lit(' and {"k": 1}'))
    return e.select("event_id", props.first_object_udf(noisy).alias("found"))


def canonical_props(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    text = F.concat(F.lit('{"z": '), F.col("user_id").cast("string"), F.lit(', "a": "'), F.col("event_type"), F.lit('", "m": [1, null]}'))
    return e.select("event_id", props.canonical_udf(text).alias("props"))


def props_equal(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    k = (F.col("event_id") % 4).cast("string")
    left = F.concat(F.lit('{"w": '), k, F.lit("}"))
    right = F.concat(F.lit('{"w": '), (F.col("user_id") % 4).cast("string"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise(""), F.lit("}"))
    return e.select("event_id", props.props_equal(left, right).alias("same"))


def token_codec_roundtrip(s, d):
    from ..operators import tokens

    lines = _mod_lines(s, d).withColumn("cut_start", F.lit(False)).withColumn("cut_end", F.lit(False))
    t = pieces.targets(lines, 256).withColumn("props", F.concat(F.lit('{"Id":"L'), F.col("feature_id").cast("string"), F.lit('"}')))
    coded = tokens.encode_items(t, ["sample_id"], 256, 640)
    return tokens.decode_items(coded, ["sample_id"], "linestring", 2, 256, 640).select("sample_id", "n_items", "saw_object", "first_props")


def grammar_mask(s, d):
    from ..operators import tokens

    lines = _mod_lines(s, d).withColumn("cut_start", F.lit(False)).withColumn("cut_end", F.lit(False))
    t = pieces.targets(lines, 256).withColumn("props", F.lit("{}"))
    ids, n = F.col("ids"), F.size("ids")
    # in turns: whole; without its end; with the end inside; a point without its second coordinate; a source where an object's end belongs; bytes first
    forms = [ids, F.slice(ids, F.lit(1), n - 1), F.concat(F.slice(ids, 1, 3), F.array(F.lit(tokens.EOS)), F.slice(ids, F.lit(4), n - 3)), F.concat(F.slice(ids, 1, 8), F.slice(ids, F.lit(10), n - 9)), F.concat(F.slice(ids, F.lit(1), n - 2), F.slice(ids, 4, 1)), F.concat(F.array(F.lit(65)), ids)]
    form = F.lit(None).cast("array<int>")
    for k, f in enumerate(forms):
        form = F.when(F.col("feature_id") % len(forms) == k, f).otherwise(form)
    coded = tokens.encode_items(t, ["sample_id", "feature_id"], 256, 640)
    return coded.select("sample_id", "feature_id", tokens.grammar_state(form, "linestring", 6, 640).alias("state"))


def chosen_tokens(s, d):
    """The best token of each walk's points after a penalty on what was said and what may follow."""
    from ..operators import tokens

    p = view(s, d, "fx_point").select("user_id", "grp", F.col("pt").alias("token"), ((F.col("px") * 7919 + F.col("py") * 104729) % 1000 - 500).cast("double").alias("score"), (F.col("px") % 3 > 0).alias("allowed"))
    said = p.where("token % 2 = 0").select("user_id", "grp", "token")
    return tokens.chosen(p, ["user_id", "grp"], said=said, penalty=2.0)


def token_limits(s, d):
    from ..operators import tokens

    e = s.read.parquet(f"{d}/events.parquet")
    most, least = tokens.limits((F.col("event_id") % 3 * 256).cast("long"), F.col("event_id") % 11 - 2, F.col("user_id") * 40)
    return e.select("event_id", most.cast("long").alias("most"), least.cast("long").alias("least"))


def geojson_roundtrip(s, d):
    from ..sources import geojson

    lines = _with_raster(s, d, _lines(s, d)).withColumn("props", F.format_string('{"Id":"L%d"}', "feature_id"))
    text = geojson.emit(lines, ["sample_id"], "Lane", "linestring", "EPSG:32650")
    back = geojson.ingest(_with_raster(s, d, text.withColumnRenamed("geojson", "text")), "linestring", 2, "EPSG:32650")
    return back.select("sample_id", F.get_json_object("props", "$.Id").alias("id"), F.size("line").alias("n_points"), _r(L.length(F.col("line")), 3).alias("length"))


def tiled_replay_predict(s, d):
    from ..streaming import tiled

    t = tiles.scan_order(_tiles(s, d))
    near = tiles.features_in_tiles(t, _envelopes(s, d)).select("sample_id", "tile_index", "feature_id", "keep_x0", "keep_y0", "keep_x1", "keep_y1")
    rows = near.join(_lines(s, d), ["sample_id", "feature_id"]).withColumn("props", F.format_string('{"Id":"L%d"}', "feature_id"))
    return tiled.merge_tiles(rows, ["sample_id"], 3.0).select("sample_id", "props", "n_points", "n_parts")


def augment_square(s, d):
    rows = _mod_lines(s, d)
    rot, h, v = (F.col("feature_id") % 4).cast("int"), F.col("feature_id") % 3 == 0, F.col("feature_id") % 5 == 0
    return _exploded(rows.withColumn("line", synthesis.augmented(F.col("line"), 256, rot, h, v)), ["sample_id", "feature_id"])


def feature_replicas(s, d):
    return synthesis.replicated(_envelopes(s, d).select("sample_id", "feature_id"), ["sample_id"], 300).select("sample_id", "feature_id", F.col("copy").cast("long").alias("copy"))


def round_robin(s, d):
    epochs = s.read.parquet(f"{d}/events.parquet").select((F.col("event_id") + 1).alias("epoch"))
    return synthesis.round_robin(epochs, view(s, d, "fx_raster").select("sample_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        tile_windows, mask_bbox, tile_mask_stats, tile_select_audit, tile_neighbors, tile_state_regions, feature_envelope_join, empty_tile_filter, work_items, keep_center_filter,
        mask_inside_ratio, line_mask_islands, affine_world, utm_roundtrip, letterbox_uv, quantise_bins, resample_polyline, boundary_side, canonical_line, canonical_ring, anchors, target_items,
        line_clip_bbox, cut_flags, hausdorff_pairs, greedy_match, lane_metrics, polygon_iou, polygon_iou_kernel, polygon_clip, polygon_metrics, dedup_nms, finite_mean, parse_rate, parse_success_rate,
        batch_plan, batch_counts, lr_schedule, shift_accuracy, running_best, weighted_loss, export_cap, capped_pieces, cache_key, prompt_meta, json_recover, canonical_props, props_equal,
        augment_square, feature_replicas, round_robin, token_codec_roundtrip, grammar_mask, chosen_tokens, token_limits, geojson_roundtrip, tiled_replay_predict,
    )
    from .more import QUERIES

    return {f.__name__: f for f in (*names, *QUERIES)}


def oracle_sql() -> dict[str, str]:
    from .more_oracle import SQL as MORE
    from .oracle import SQL

    return SQL | MORE
