"""Further queries over the fixtures: preparation, prediction, evaluation, texts and training analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import lines as L
from ..functions import prompts
from ..functions import props as P
from ..operators import match, metrics, pieces, prepare, synthesis, tiles
from . import jobs
from .fixtures import view
from .queries import MARGIN, OVERLAP, TILE, _boxes, _decoded, _envelopes, _exploded, _hits, _lines, _mod_lines, _r, _tiles

UTM = "EPSG:32650"


def _raster(s, d) -> DataFrame:
    return view(s, d, "fx_raster")


def _scan(s, d) -> DataFrame:
    return tiles.scan_order(_tiles(s, d))


def _named(df: DataFrame) -> DataFrame:
    """Features with an Id of their own."""
    return df.withColumn("props", F.format_string('{"Id":"L%d"}', "feature_id"))


def _event_texts(s, d, *forms: str) -> DataFrame:
    """Each event with the text of its form, in turns; %d is its user."""
    e = s.read.parquet(f"{d}/events.parquet")
    text = F.when(F.lit(False), "")
    for i, form in enumerate(forms):
        text = text.when(F.col("event_id") % len(forms) == i, F.replace(F.lit(form), F.lit("%d"), F.col("user_id").cast("string")))
    return e.select("event_id", text.alias("text"))


def clamped_points(s, d):
    """Model coordinates clamped to the image."""
    p = view(s, d, "fx_point")
    return p.select("sample_id", "feature_id", "pt", _r(C.clamp(F.col("px") * 0.3 - 20, 256)).alias("u"), _r(C.clamp(F.col("py") * 0.3 - 20, 256)).alias("v"))


def canonical_line_lex(s, d):
    return _exploded(_mod_lines(s, d).withColumn("line", L.canonical_line_lex(F.col("line"))), ["sample_id", "feature_id"])


def sorted_features(s, d):
    """Features of a sample in the order of their sort key."""
    rows = prepare.ranked(_named(_lines(s, d)), 2)
    return rows.select("sample_id", "feature_id", F.col("order")[0].alias("place"))


def expanded_boxes(s, d):
    t = _tiles(s, d)
    box = tiles.expand_box([F.when(F.col("candidate_index") % 3 > 0, F.col(c)) for c in ("x0", "y0", "x1", "y1")], 50, F.col("width"), F.col("height"))
    return t.select("sample_id", "candidate_index", *(b.cast("long").alias(c) for b, c in zip(box, ("ex0", "ey0", "ex1", "ey1"), strict=True)))


def _ring(x0: Column | str, shift: Column | float = 0.0) -> Column:
    at = lambda x, y: L.point(F.col(x) + shift, F.col(y))
    return F.array(F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")))


def rings_equal(s, d):
    """Boxes' rings against themselves moved by up to 0.08 pixels: the tolerance grows with the coordinate."""
    b = _boxes(s, d)
    moved = _ring("x0", (F.col("id") % 9) * 0.01)
    return b.select("sample_id", "id", prepare.rings_equal(moved, _ring("x0")).alias("same"))


def world_geometries(s, d):
    return _exploded(prepare.to_world(_lines(s, d), _raster(s, d)), ["sample_id", "feature_id"], n=4)


def mixed_crs(s, d):
    """Lines of one table in three coordinate systems, each text's own, into rasters of two: no system is named outside the rows."""
    from ..sources import geojson

    p = view(s, d, "fx_point")
    own = F.when(F.col("feature_id") % 3 == 0, "EPSG:32650").when(F.col("feature_id") % 3 == 1, "EPSG:32651").otherwise(C.CRS84)
    p = p.withColumn("crs", own).withColumn("q", C.projected(F.col("px") * 0.001 + 116.0, F.col("py") * 0.001 + 39.0, F.lit("EPSG:4326"), F.col("crs")))
    lines = p.groupBy("sample_id", "feature_id", "crs").agg(L.points(F.col("pt"), F.col("q.x"), F.col("q.y")).alias("line"))
    told = F.to_json(F.transform("line", lambda v: F.array(v["x"], v["y"])))
    text = F.concat(F.lit('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"'), F.col("crs"), F.lit('"}},"features":[{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":'), told, F.lit("}}]}"))
    ground = _raster(s, d).withColumn("raster_crs", F.when(F.col("sample_id") % 2 == 0, UTM).otherwise("EPSG:32651"))
    texts = lines.select("sample_id", "feature_id", text.alias("text")).join(ground, "sample_id")
    return _exploded(geojson.ingest(texts, "linestring", 2, F.col("raster_crs")), ["sample_id", "feature_id"], n=2)


def shifted_lines(s, d):
    rows = _lines(s, d).join(_raster(s, d).select("sample_id", "width", "height"), "sample_id")
    return _exploded(rows.withColumn("line", synthesis.shifted(F.col("line"), F.lit(300), F.lit(-200), F.col("width"), F.col("height"))), ["sample_id", "feature_id"])


def grid_offsets(s, d):
    p = _envelopes(s, d).join(_raster(s, d).select("sample_id", "width", "height"), "sample_id")
    x, y = synthesis.grid_offset(F.col("feature_id") % 30, 30, F.col("width"), F.col("height"), 1)
    return p.select("sample_id", "feature_id", _r(x, 4).alias("dx"), _r(y, 4).alias("dy"))


def any_vertex_inside(s, d):
    return _lines(s, d).select("sample_id", "feature_id", L.any_inside(F.col("line"), F.lit(200), F.lit(150), F.lit(1000), F.lit(800)).alias("inside"))


def stage_tiles(s, d):
    """Training tiles: searched in the padded extent of the review, by coverage."""
    t = tiles.for_stage(_raster(s, d), view(s, d, "fx_review"), TILE, OVERLAP, MARGIN, 0.02, 150_000, 3, False, True, 32)
    return t.select("sample_id", "tile_index", "x0", "y0", "x1", "y1", "mask_pixels")


def prediction_tiles(s, d):
    """Without a mask and with tiling on or off (two samples in turn)."""
    r = _raster(s, d)
    on = tiles.for_stage(r.where("sample_id % 2 = 0"), None, TILE, OVERLAP, MARGIN)
    off = tiles.for_stage(r.where("sample_id % 2 = 1"), None, TILE, OVERLAP, MARGIN, on=False)
    cols = ["sample_id", "tile_index", "x0", "y0", "x1", "y1"]
    return on.select(cols).unionByName(off.select(cols))


def feature_strip_join(s, d):
    """Features that reach a tile's state strips."""
    strips = tiles.state_regions(_scan(s, d), 128)
    rows = prepare._near(prepare.ranked(_named(_lines(s, d)), 2), F.col("line"), _scan(s, d))
    return prepare._in_strips(rows, F.col("line"), strips).select("sample_id", "tile_index", F.col("strip").cast("long").alias("strip"), "feature_id")


def prepare_features(s, d):
    """Reviewed runs of lines in tiles, resampled, at most 40 a tile, sorted."""
    out = prepare.lines(_named(_lines(s, d)), _scan(s, d), 2, 30.0, 40, _hits(s, d))
    return out.select("sample_id", "tile_index", "feature_id", "place", "cut_start", "cut_end", F.size("line").cast("long").alias("n_points"), _r(L.length(F.col("line")), 4).alias("length"))


def prepare_state(s, d):
    """The same pieces as far as they lie in the tiles' state strips."""
    out = prepare.lines(_named(_lines(s, d)), _scan(s, d), 2, None, 0, None, tiles.state_regions(_scan(s, d), 128))
    return out.groupBy("sample_id", "tile_index").agg(F.count("*").alias("n_pieces"), _r(F.sum(L.length(F.col("line"))), 3).alias("length"))


def prepare_polygons(s, d):
    rows = _boxes(s, d).select("sample_id", F.col("id").alias("feature_id"), F.lit("{}").alias("props"), _ring("x0").alias("rings"))
    out = prepare.areas(rows, _scan(s, d))
    return out.select("sample_id", "tile_index", "feature_id", "clipped", _r(L.area(F.col("line")), 4).alias("area"))


def _ribbons(s, d, name: str = "fx_point") -> DataFrame:
    """Walks widened to polygons that are no rectangles and not convex: sample_id, id, rings, line (the outer ring), x from place to place at least one further."""
    rows = _lines(s, d, name, F.col("px") + F.col("pt"), F.col("py"))
    wide = (15 + F.col("feature_id") % 40).cast("double")
    ring = F.concat("line", F.reverse(F.transform("line", lambda p: L.point(p["x"], p["y"] + wide))))
    return rows.select("sample_id", F.col("feature_id").alias("id"), F.array(ring).alias("rings"), ring.alias("line"))


def ring_iou(s, d):
    """Moved ribbons against ribbons: pairs that overlap by three tenths."""
    return match.polygon_pairs(_ribbons(s, d, "fx_pred"), _ribbons(s, d), ["sample_id"], 0.3).select("sample_id", "pred", "gt", _r(F.col("iou")).alias("iou"))


def _changed(s, d) -> DataFrame:
    return view(s, d, "fx_pred").groupBy("sample_id", F.col("feature_id").alias("id")).agg(F.max("prop_changed").alias("c"))


def _ring_scores(s, d) -> DataFrame:
    told = lambda c: F.format_string('{"Id":%d,"Changed":%d}', "id", c)
    pred = _ribbons(s, d, "fx_pred").join(_changed(s, d), ["sample_id", "id"]).withColumn("props", told(F.col("c"))).drop("c")
    return jobs.evaluate_areas(pred, _ribbons(s, d).withColumn("props", told(F.lit(0))), _raster(s, d), _decoded(s, d))


def ring_metrics(s, d):
    """Polygon measures in metres, by sample."""
    return _ring_scores(s, d).select("sample_id", *(_r(F.col(c), 5).alias(c) for c in ("precision", "recall", "f1", "mean_iou", "property_acc", "parse_ok_rate")), "pred_count", "gt_count")


def ring_report(s, d):
    return jobs.report(_ring_scores(s, d)).select("name", _r(F.col("mean"), 4).alias("mean"))


def ring_dedup(s, d):
    """Ribbons and their moved copies under one Id each: of two that overlap by 0.69 the larger stays, or the last."""
    own = lambda name, k: _ribbons(s, d, name).select("sample_id", (F.col("id") * 2 + k).alias("id"), F.format_string('{"Id":"L%d"}', "id").alias("props"), "line", "rings")
    return jobs.dedup_areas(own("fx_point", 0).unionByName(own("fx_pred", 1)), _raster(s, d), 0.69).select("sample_id", "id")


def _opened(scan: DataFrame) -> DataFrame:
    """What an answer to each tile begins with, as its part 0."""
    return scan.select("sample_id", "tile_index", F.lit(0).cast("long").alias("part"), F.when(F.col("tile_index") % 5 == 3, "Answer {cut: ").otherwise("").alias("text"))


def predict_areas(s, d):
    """Answers with polygons to final features, counted by sample; tiles three after a multiple of five are answered by prose that is cut off."""
    from ..sources import geojson

    scan, ribbons = _scan(s, d), _ribbons(s, d)
    e = ribbons.withColumn("e", L.envelope(F.col("line"))).select("sample_id", "id", *(F.col(f"e.{c}").alias(f"r{c}") for c in prepare.BOX))
    near = tiles.features_in_tiles(scan, e).select("sample_id", "tile_index", "id").join(ribbons, ["sample_id", "id"]).withColumn("props", F.format_string('{"Id":"L%d"}', "id"))
    told = geojson.emit_parts(near.where("tile_index % 5 <> 3").join(_raster(s, d), "sample_id"), ["sample_id", "tile_index"], "Intersection", "polygon", UTM, UTM)
    said = _opened(scan).unionByName(told.drop("last"))
    p = jobs.predict(said, scan, _raster(s, d), "Intersection", UTM, UTM, places=6, geometry="polygon")
    per = p.tiles.groupBy("sample_id").agg(F.count_if("decoded_ok").alias("decoded_ok_count"), F.sum("n_features").alias("n_pred"), F.sum("n_kept").alias("n_kept"))
    return per.join(p.final.groupBy("sample_id").agg(F.count("*").alias("n_final")), "sample_id", "left").fillna(0, ["n_final"])


def ring_targets(s, d):
    turned = F.transform(_ring("x0"), lambda r: F.concat(F.slice(r, F.col("id").cast("int") % 4 + 1, 4), F.slice(r, F.lit(1), F.col("id").cast("int") % 4)))
    rows = prepare.ring_targets(_boxes(s, d).withColumn("rings", turned).withColumn("clipped", F.col("id") % 2 == 0), 256)
    return rows.select("sample_id", "id", "cut_in", "cut_out", "source", _r(F.col("line")[0]["x"]).alias("x"), _r(F.col("line")[0]["y"]).alias("y"), _r(F.col("line")[1]["x"]).alias("x2"))


def items_from_uv(s, d):
    """Lines to a tile's uv and back, with leniently read properties."""
    t = _tiles(s, d).select("sample_id", "candidate_index", C.letterbox(F.col("width"), F.col("height"), F.lit(256), [F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("box"))
    near = tiles.features_in_tiles(_tiles(s, d), _envelopes(s, d)).select("sample_id", "candidate_index", "feature_id")
    rows = near.join(t, ["sample_id", "candidate_index"]).join(_lines(s, d), ["sample_id", "feature_id"])
    uv = rows.withColumn("line", F.transform("line", lambda p: L.point(*C.to_uv(p["x"], p["y"], F.col("box"))))).withColumn("props", F.format_string("“Id”：%d，", "feature_id"))
    back = prepare.from_uv(uv)
    return back.select("sample_id", "candidate_index", "feature_id", "props", _r(F.col("line")[0]["x"], 5).alias("x"), _r(F.element_at("line", -1)["y"], 5).alias("y"))


def dedup_lines(s, d):
    """Labels and their moved copies under one Id each: of two within 1.1 m the longer stays, or the last."""
    own = lambda name, k: _named(_lines(s, d, name)).select("sample_id", (F.col("feature_id") * 2 + k).alias("id"), "props", "line")
    return jobs.dedup_lines(own("fx_point", 0).unionByName(own("fx_pred", 1)), _raster(s, d), 1.1).select("sample_id", "id")


def answers(s, d) -> DataFrame:
    """A model's answers as a table, in parts: each tile's features as GeoJSON within prose; every fifth answer is cut off, tiles without features are answered by nothing."""
    from ..sources import geojson

    scan = _scan(s, d)
    near = tiles.features_in_tiles(scan, _envelopes(s, d)).select("sample_id", "tile_index", "feature_id")
    rows = _named(near.join(_lines(s, d), ["sample_id", "feature_id"])).join(_raster(s, d), "sample_id")
    told = geojson.emit_parts(rows, ["sample_id", "tile_index"], "Lane", "linestring", UTM, UTM).where("tile_index % 5 <> 3 or part = 1")
    whole = F.concat(F.when(F.col("part") == 1, "Answer: ").otherwise(""), "text", F.when(F.col("last"), " end").otherwise(""))
    text = F.when(F.col("tile_index") % 5 == 3, F.substring("text", 1, 60)).otherwise(whole)
    return _opened(scan).unionByName(told.select("sample_id", "tile_index", "part", text.alias("text")))


def _predicted(s, d) -> jobs.Prediction:
    return jobs.predict(answers(s, d), _scan(s, d), _raster(s, d), "Lane", UTM, UTM, places=6)


def predict_replay(s, d):
    """Answers to final features, counted by sample."""
    p = _predicted(s, d)
    per = p.tiles.groupBy("sample_id").agg(F.count("*").alias("tile_count"), F.count_if("decoded_ok").alias("decoded_ok_count"), F.count_if(F.col("n_features") > 0).alias("non_empty_tiles"), F.sum("n_features").alias("n_pred"), F.sum("n_kept").alias("n_kept"))
    return per.join(p.final.groupBy("sample_id").agg(F.count("*").alias("n_final")), "sample_id", "left").fillna(0, ["n_final"])


def collect_state(s, d):
    """What each tile is told of its predecessors."""
    return _predicted(s, d).state.select("sample_id", "tile_index", "place", "props", F.size("line").cast("long").alias("n_points"), _r(L.length(F.col("line")), 4).alias("length"))


def _evaluated(s, d) -> DataFrame:
    changed = view(s, d, "fx_pred").groupBy("sample_id", "feature_id").agg(F.max("prop_changed").alias("c"))
    made = lambda df, c: df.select("sample_id", F.col("feature_id").alias("id"), F.format_string('{"Id":%d,"Changed":%d}', "feature_id", c).alias("props"), "line")
    pred = made(_lines(s, d, "fx_pred").join(changed, ["sample_id", "feature_id"]), F.col("c"))
    return jobs.evaluate(pred, made(_lines(s, d), F.lit(0)), _raster(s, d), _decoded(s, d), 1.2)


def evaluate(s, d):
    """Lane measures in metres, by sample."""
    out = _evaluated(s, d)
    return out.select("sample_id", *(_r(F.when(F.abs(F.col(c)) == float("inf"), -1.0).otherwise(F.col(c)), 5).alias(c) for c in ("precision", "recall", "f1", "mean_hausdorff", "mean_endpoint_error", "property_acc", "parse_ok_rate")), "pred_count", "gt_count", "unmatched_pred", "unmatched_gt")


def evaluate_report(s, d):
    return jobs.report(_evaluated(s, d)).select("name", _r(F.col("mean"), 4).alias("mean"))


def feature_collections(s, d):
    forms = ('{"type": "FeatureCollection", "features": [{"k": %d}]}', '{"type": "Feature", "properties": {"k": %d}}', '{"features": [%d], "name": "N"}', '{"type": "FeatureCollection", "features": %d}', "no json %d")
    return _event_texts(s, d, *forms).select("event_id", P.collection(F.col("text"), "Lane").alias("found"))


def _spoilt(s, d, *marks: str) -> DataFrame:
    """Events as JSON of their own fields, then spoilt in turns: single quotes, a comma too many, marks of another script, no braces, cut off."""
    e = s.read.parquet(f"{d}/events.parquet")
    text = F.concat(F.lit('{"u": '), F.col("user_id").cast("string"), F.lit(', "t": "'), F.col("event_type"), F.lit('", "n": ['), (F.col("event_id") % 10).cast("string"), F.lit("]}"))
    turn = F.col("event_id") % 6
    wide = text
    for a, b in zip(marks[::2], marks[1::2], strict=True):
        wide = F.replace(wide, F.lit(a), F.lit(b))
    spoilt = F.when(turn == 0, text).when(turn == 1, F.replace(text, F.lit('"'), F.lit("'"))).when(turn == 2, F.replace(text, F.lit("]}"), F.lit(" , ], }"))).when(turn == 3, wide)
    return e.select("event_id", spoilt.when(turn == 4, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(F.substring(text, F.lit(1), F.length(text) - 4)).alias("text"))


def parsed_props(s, d):
    return _spoilt(s, d, ":", "：", ",", "，").select("event_id", P.parse_udf("text").alias("props"))


def relaxed_props(s, d):
    return _spoilt(s, d, ":", "：", ",", "；", '"', "“").select("event_id", P.parse_relaxed_udf("text").alias("props"))


def truth_flags(s, d):
    """Flags from words of the events' types and numbers: what is no flag takes the default."""
    e = s.read.parquet(f"{d}/events.parquet")
    word = F.element_at(F.array(*(F.lit(w) for w in ("yes", "no", "on", "off", "true", "false", "1", "0", ""))), (F.col("event_id") % 9 + 1).cast("int"))
    text = F.when(F.col("user_id") % 4 == 0, F.upper(word)).when(F.col("user_id") % 4 == 1, F.concat(F.lit(" "), word)).when(F.col("user_id") % 4 == 2, F.col("event_type")).otherwise((F.col("event_id") % 3).cast("string"))
    return e.select("event_id", P.truth(text, False).alias("a"), P.truth(text, True).alias("b"))


def task_prompts(s, d):
    t = _scan(s, d)
    return t.select("sample_id", "tile_index", prompts.task_prompt(F.concat(F.lit("GeoMeta "), F.col("x0").cast("string")), F.lit("  "), F.lit(" Find lanes."), F.lit("Write JSON."), F.col("has_left") | F.col("has_top")).alias("prompt"))


def state_texts(s, d):
    e = _envelopes(s, d).select("sample_id", "feature_id", F.when(F.col("feature_id") % 2 == 0, "left").otherwise("top").alias("side"), F.array(L.point(F.col("rx0"), F.col("ry0")), L.point(F.col("rx1"), F.col("ry1"))).alias("line"))
    one = e.select("sample_id", "feature_id", prompts.state_text(F.when(F.col("feature_id") % 3 == 0, F.array().cast("array<struct<side:string,line:array<struct<x:double,y:double>>>>")).otherwise(F.array(F.struct("side", "line"))), F.lit("{}")).alias("text"))
    return one


def target_texts(s, d):
    rows = _mod_lines(s, d).withColumn("cut_start", F.col("feature_id") % 3 == 0).withColumn("cut_end", F.col("feature_id") % 2 == 0)
    t = pieces.targets(rows, 256)
    return t.select("sample_id", "feature_id", prompts.target_text(F.array(F.struct("cut_in", "cut_out")), F.lit("{}")).alias("text"))


def raw_dumps(s, d):
    t = _scan(s, d)
    return t.groupBy("sample_id").agg(prompts.raw_dump(F.col("tile_index"), F.when(F.col("tile_index") % 4 > 0, F.concat(F.lit("t"), F.col("x0").cast("string")))).alias("dump"))


def cut_counts(s, d):
    rows = _mod_lines(s, d).withColumn("cut_start", F.col("feature_id") % 3 == 0).withColumn("cut_end", F.col("feature_id") % 2 == 0)
    a, b = prompts.cut_counts(F.col("cut_in"), F.col("cut_out"))
    return pieces.targets(rows, 256).groupBy("sample_id").agg(F.count("*").alias("n"), a.alias("n_in"), b.alias("n_out"))


def memory_risks(s, d):
    """Runs with settings from parts' attributes, by the risk table."""
    p, k = s.read.parquet(f"{d}/part.parquet"), F.col("p_partkey")
    mode = F.when(k % 3 == 0, "full").when(k % 3 == 1, " LoRA").otherwise("frozen")
    runs = p.select(
        k, mode.alias("llm_train_mode"), (F.col("p_size") * 10).alias("image_size"), (k % 4 * 512).alias("target_max_tokens"), (F.col("p_size") % 3 * 400).alias("state_max_tokens"), (k % 2 * 128).alias("prompt_max_tokens"), (k % 5 * 30).alias("lane_max_features"),
        (F.col("p_size") % 4 * 15).alias("intersection_max_features"), (k % 7 * 4).alias("state_max_features"), (F.col("p_size") % 4).alias("batch_size"), (k % 2 == 0).alias("amp"), (F.col("p_retailprice") > 1400).alias("gradient_checkpointing"),
    )
    out = metrics.memory_risk(runs)
    return out.select("p_partkey", "score", "level", F.array_join("reasons", ";").alias("reasons"), F.array_join("suggestions", ";").alias("suggestions"))


def subset_batches(s, d):
    """The items of each sample's second and fourth batch."""
    items = _envelopes(s, d).select("sample_id", (F.col("feature_id") % 50).alias("tile_index"), F.lit(0).alias("task_order"), F.col("feature_id").alias("idx"))
    return metrics.in_batches(items, 16, [1, 3]).select("sample_id", "idx", "batch", "place")


def configured_prompts(s, d):
    """Prompts of the default tasks from a configuration."""
    from ..sources import config

    lane, crossing = config.DEFAULT_TASKS
    c = {"prompt": {"with_state_suffix": " Go on. ", "include_geospatial_context": True}}
    t = _scan(s, d)
    state, meta = F.col("has_left") | F.col("has_top"), F.concat(F.lit("Place "), F.col("x0").cast("string"))
    return t.select("sample_id", "tile_index", prompts.configured(lane, c, meta, state).alias("lane"), prompts.configured(crossing, {"prompt": {"include_geospatial_context": "no"}}, meta, state).alias("crossing"))


def parameter_summary(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("module"), F.col("p_size").cast("long").alias("n_values"), (F.col("p_partkey") % 3 == 0).alias("trainable"))
    return metrics.parameter_summary(p)


def stitched_counts(s, d):
    """Features before and after near-duplicates go, by sample."""
    own = lambda name, k: _named(_lines(s, d, name)).select("sample_id", (F.col("feature_id") * 2 + k).alias("id"), "props", "line")
    before = own("fx_point", 0).unionByName(own("fx_pred", 1))
    after = jobs.dedup_lines(before, _raster(s, d), 1.1)
    return metrics.stitched_counts(before, after, ["sample_id"])


def grouped_indices(s, d):
    return metrics.grouped_indices(_envelopes(s, d).select("sample_id", F.col("feature_id").alias("idx"), (F.col("feature_id") % 5).alias("tile_index"), F.lit(0).alias("task_order"))).select("sample_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"))


def best_tokens(s, d):
    rows = view(s, d, "fx_point").select("user_id", "grp", "pt", ((F.col("px") * 7919 + F.col("py") * 104729) % 1000).alias("score"))
    return metrics.best_tokens(rows, ["user_id", "grp"], "pt", "score")


def truncated_tokens(s, d):
    from ..operators import tokens

    e = s.read.parquet(f"{d}/events.parquet")
    ids = tokens.finalise(tokens.byte_ids(F.col("event_type")), 6)
    return e.select("event_id", F.size(ids).cast("long").alias("n"), F.array_contains(ids, tokens.EOS).alias("ends"))


def prediction_audit(s, d):
    """Answers beside the audit of the tile that they belong to."""
    t = _scan(s, d)
    a = tiles.audit(tiles.mask_stats(_tiles(s, d), view(s, d, "fx_mask")), 0.3, 200_000, 4).select("sample_id", "x0", "y0", "selected", "reason")
    return t.join(a, ["sample_id", "x0", "y0"]).select("sample_id", "tile_index", "selected", "reason")


def sample_dirs(s, d):
    paths = _envelopes(s, d).select("feature_id", F.concat(F.lit("/data/train/s"), F.col("feature_id").cast("string"), F.lit("/patch_tif/0.tif")).alias("path"))
    return paths.select("feature_id", synthesis.sample_dir(F.col("path"), "patch_tif/0.tif").alias("sample_dir"))


QUERIES = (
    clamped_points, canonical_line_lex, sorted_features, expanded_boxes, rings_equal, world_geometries, mixed_crs, shifted_lines, grid_offsets, any_vertex_inside, stage_tiles, prediction_tiles, feature_strip_join,
    prepare_features, prepare_state, prepare_polygons, ring_iou, ring_metrics, ring_report, ring_dedup, predict_areas, ring_targets, items_from_uv, dedup_lines, predict_replay, collect_state, evaluate, evaluate_report, feature_collections, parsed_props, relaxed_props, truth_flags,
    task_prompts, state_texts, target_texts, raw_dumps, cut_counts, memory_risks, subset_batches, configured_prompts, parameter_summary, stitched_counts, grouped_indices, best_tokens, truncated_tokens, prediction_audit, sample_dirs,
)
