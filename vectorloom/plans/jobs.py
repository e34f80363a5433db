"""Whole jobs: predictions from a model's answers, their files, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import lines as L
from ..functions import prompts
from ..functions import props as P
from ..operators import match, metrics, prepare
from ..operators.rounds import Steps, settled
from ..sources import config as C
from ..sources import exports, geojson
from ..streaming import tiled


@dataclass
class Prediction:
    """``tiles``: sample_id, tile_index, decoded_ok, n_features, n_kept; ``merged`` and ``final``: sample_id, id, props, line (rings for polygons), n_parts before and after near-duplicates go; ``state``: what each tile was told."""

    tiles: DataFrame
    merged: DataFrame
    final: DataFrame
    state: DataFrame


def parsed(answers: DataFrame, name: str) -> DataFrame:
    """Answers (sample_id, tile_index, text) with found, the feature collection in the text, and decoded_ok: there is one, or the answer is empty."""
    found = answers.withColumn("found", P.collection(P.first_object_udf(F.coalesce("text", F.lit(""))), name))
    return found.withColumn("decoded_ok", F.col("found").isNotNull() | (F.trim(F.coalesce("text", F.lit(""))) == ""))


def _read(key: list[str]):
    """Features (source_index, feature) of texts that stream by in parts, in the order of key and part, and a row without them for each text: whether it is settled, and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, answer, n, schema, waiting = None, None, 0, None, ([], [])

        def made(index: list, found: list, *status: bool | None) -> pa.RecordBatch:
            rows = {c: [v] * len(found) for c, v in zip(key, at, strict=True)} | {"source_index": index, "feature": found, "settled": status[:1] * len(found), "decoded_ok": status[1:] * len(found)}
            return pa.RecordBatch.from_pydict(rows, schema)

        def read(told: list[str | None], most: int = 4096) -> Iterator[pa.RecordBatch]:
            nonlocal n, waiting
            for feature in told:
                if feature is not None:
                    waiting[0].append(n)
                    waiting[1].append(feature)
                n += 1
                if len(waiting[0]) >= most:
                    yield made(*waiting, None, None)
                    waiting = ([], [])

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if answer is not None:
                yield from read(answer.ended())
                yield made(*waiting, None, None)
                waiting = ([], [])
                yield made([None], [None], answer.settled, answer.decoded)

        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(c) for c in key), ("source_index", pa.int32()), ("feature", pa.string()), ("settled", pa.bool_()), ("decoded_ok", pa.bool_())])
            for begin, end in match.runs(batch, key):
                of = tuple(batch.slice(begin, 1).select(key).to_pylist()[0].values())
                if of != at:
                    yield from closed()
                    at, answer, n = of, P.Answer(), 0
                for k in range(begin, end):
                    yield from read(answer.feed(batch["text"][k].as_py()))
        yield from closed()

    return run


def answered(answers: DataFrame, name: str, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Of answers (sample_id, tile_index, text, and part where a text comes in several rows): sample_id, tile_index, decoded_ok; and their features (source_index, feature). Plain collections are read as they stream by; only other texts are put together
    and ``parsed`` as a whole."""
    key = ["sample_id", "tile_index"]
    pieces = answers.select(*key, F.col("part") if "part" in answers.columns else F.lit(0).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = steps.kept(pieces, "pieces")
    tasks = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.repartition(tasks, *key).sortWithinPartitions(*key, "part").select(*key, "text")
    schema = StructType([*(rows.schema[c] for c in key), *StructType.fromDDL("source_index int, feature string, settled boolean, decoded_ok boolean").fields])
    told = steps.kept(rows.mapInArrow(_read(key), schema), "told")
    status = told.where("source_index is null")
    whole = pieces.join(status.where("not settled").select(*key), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("all"))
    whole = steps.kept(parsed(whole.select(*key, F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text")), name), "whole")
    steps.drop("pieces")
    read = status.where("settled").select(*key, "decoded_ok").unionByName(whole.select(*key, "decoded_ok"))
    plain = told.where("source_index is not null").join(status.where("settled").select(*key), key, "left_semi")
    # numbers are written as ``collection`` writes them
    plain = plain.select(*key, "source_index", F.coalesce(F.to_json(F.try_parse_json("feature")), "feature").alias("feature"))
    return read, plain.unionByName(geojson.elements(whole.where("found is not null").select(*key, F.col("found").alias("text"))))


def predict(answers: DataFrame, tiles: DataFrame, rasters: DataFrame, name: str, raster_crs: str, source_crs: str | None, margin: int = 128, interval: float | None = None, most: int = 32, distance: float = 1.0, places: int | None = None, geometry: str = "linestring", least: int | None = None, iou: float = 0.5) -> Prediction:
    """Features of the answers to each tile (a table replays a model): the answer's collection in pixels, what lies in the keep box merged tile by tile in scan order (lines; a polygon is always a new feature), and near-duplicates
    dropped: lines within ``distance`` metres, polygons that overlap with at least ``iou``. ``tiles``: as ``tiles.scan_order`` gives them. ``places`` rounds pixels. Without ``source_crs`` an answer's own system counts, and an answer
    must be one row; else it may come in parts (``answered``)."""
    from ..operators.tiles import state_regions

    steps = Steps(answers.sparkSession)
    area = geometry == "polygon"
    least = least or (3 if area else 2)
    box = tiles.select("sample_id", "tile_index", *(f"keep_{c}" for c in prepare.BOX))
    scales = rasters.select("sample_id", "a", "c", "e", "f")
    if source_crs is None:
        read = steps.kept(parsed(answers, name), "read")
        texts = read.where("found is not null").select("sample_id", "tile_index", F.col("found").alias("text"))
        features = geojson.ingest(texts.join(scales, "sample_id"), geometry, least, raster_crs)
    else:
        read, found = answered(answers, name, steps)
        features = geojson.ingest_elements(found.join(scales, "sample_id"), geometry, least, raster_crs, source_crs)
    features = features.join(box, ["sample_id", "tile_index"]).withColumnRenamed("source_index", "feature_id")
    if places is not None:
        rounded = lambda p: L.point(F.round(p["x"], places), F.round(p["y"], places))
        features = features.withColumn("line", F.transform("line", rounded))
        features = features.withColumn("rings", F.transform("rings", lambda r: F.transform(r, rounded))) if area else features
    features = steps.kept(features, "features")
    kept = tiled.kept(features)
    strips = state_regions(tiles, margin)
    asking = strips.select("sample_id", "tile_index", *prepare.BOX).distinct()
    folded = steps.kept(tiled.fold(kept, ["sample_id"], joins=not area, tiles=asking), "folded")
    shape = ["line", "rings"] if area else ["line"]
    merged = folded.where("tile_index is null").select("sample_id", F.col("place").alias("id"), "props", *shape, "n_parts")
    memory = folded.where("tile_index is not null").join(asking, ["sample_id", "tile_index"])
    number = lambda df, n: df.groupBy("sample_id", "tile_index").agg(F.count("*").alias(n))
    per_tile = read.select("sample_id", "tile_index", "decoded_ok").join(number(features, "n_features"), ["sample_id", "tile_index"], "left").join(number(kept, "n_kept"), ["sample_id", "tile_index"], "left").fillna(0, ["n_features", "n_kept"])
    final = dedup_areas(merged, rasters, iou) if area else dedup_lines(merged, rasters, distance)
    return Prediction(per_tile, merged, final, prepare.state(memory, strips, least, interval, most))


def _bucketed(world: DataFrame) -> DataFrame:
    """Features with the bucket of their properties: only within one can two be near-duplicates, so what lies in one place under names of its own meets nothing. Kept as a step, as plans that repeat the geometry compute it for every use."""
    return settled(world.withColumn("bucket", P.props_bucket(F.col("props"))))


def _without(features: DataFrame, world: DataFrame, size: DataFrame, pairs: DataFrame) -> DataFrame:
    """``features`` without those that a larger one with equal properties makes a near-duplicate (``pairs``: sample_id, a, b). A sample with at most one sound geometry (``world``) keeps all its rows; otherwise unsound ones go."""
    side = lambda n: world.select("sample_id", F.col("id").alias(n), F.col("props").alias(f"props_{n}"))
    foes = pairs.where("a < b").select("sample_id", "a", "b").join(side("a"), ["sample_id", "a"]).join(side("b"), ["sample_id", "b"]).where(P.props_equal(F.col("props_a"), F.col("props_b")))
    stay = match.suppress(size, foes, ["sample_id"])
    several = size.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select("sample_id")
    judged = features.join(several, "sample_id", "left_semi").join(stay, ["sample_id", "id"], "left_semi")
    return judged.unionByName(features.join(several, "sample_id", "left_anti"))


def dedup_lines(features: DataFrame, rasters: DataFrame, distance: float = 1.0) -> DataFrame:
    """Features (sample_id, id, props, line in pixels) without near-duplicates: of lines with equal properties within ``distance`` metres (Hausdorff), the longest stays, of equally long ones the last."""
    # pixels that are no whole numbers leave equal lengths different in their last digits
    world = _bucketed(prepare.to_world(features, rasters, size=lambda a, e: F.round(L.scaled_length(F.col("line"), a, e), 6)))
    size = world.select("sample_id", "id", "size")
    alike = world.where("bucket is not null")
    return _without(features, world, size, match.line_pairs(alike, alike, ["sample_id", "bucket"], distance, ("a", "b")))


def dedup_areas(features: DataFrame, rasters: DataFrame, iou: float = 0.5, cell: float = 64.0) -> DataFrame:
    """Features (sample_id, id, props, line and rings in pixels) without near-duplicates: of polygons with equal properties that overlap with at least ``iou``, the largest stays, of equally large ones the last."""
    # pixels that are no whole numbers leave equal areas different in their last digits
    world = _bucketed(prepare.to_world(features, rasters, 3, lambda a, e: F.round(match.ring_area(F.col("rings")) * F.abs(a * e), 3)))
    size = world.select("sample_id", "id", "size")
    alike = world.where("bucket is not null")
    return _without(features, world, size, match.polygon_pairs(alike, alike, ["sample_id", "bucket"], iou, ("a", "b"), cell, few=True))


def _evaluated(p: DataFrame, g: DataFrame, taken: DataFrame, tiles: DataFrame, scores) -> DataFrame:
    side = lambda df, n: df.select("sample_id", F.col("id").alias(n), F.col("props").alias(f"props_{n}"))
    matches = taken.join(side(p, "pred"), ["sample_id", "pred"]).join(side(g, "gt"), ["sample_id", "gt"]).withColumn("same_props", P.props_equal(F.col("props_pred"), F.col("props_gt")))
    rates = metrics.parse_rates(tiles, ["sample_id"]).select("sample_id", F.col("rate").alias("parse_ok_rate"))
    return scores(g.select("sample_id").distinct(), p, g, matches, ["sample_id"]).join(rates, "sample_id", "left").fillna(0.0, ["parse_ok_rate"])


def evaluate(pred: DataFrame, gt: DataFrame, rasters: DataFrame, tiles: DataFrame, distance: float = 2.0) -> DataFrame:
    """The lane measures of each sample that has ground truth (sample_id, id, props, line in pixels), with parse_ok_rate: predictions and ground truth match one to one within ``distance`` metres."""
    p, g = prepare.to_world(pred, rasters), prepare.to_world(gt, rasters)
    order = [F.round("distance", 6), F.round("endpoint_error", 6)]
    taken = match.greedy(match.line_pairs(p, g, ["sample_id"], distance), ["sample_id"], order, carry=["distance", "endpoint_error"])
    return _evaluated(p, g, taken, tiles, metrics.lane_scores)


def evaluate_areas(pred: DataFrame, gt: DataFrame, rasters: DataFrame, tiles: DataFrame, iou: float = 0.3, cell: float = 64.0) -> DataFrame:
    """The polygon measures of each sample that has ground truth (sample_id, id, props, line and rings in pixels), with parse_ok_rate: predictions and ground truth match one to one where they overlap with at least ``iou``."""
    p, g = settled(prepare.to_world(pred, rasters, 3)), settled(prepare.to_world(gt, rasters, 3))
    return _evaluated(p, g, match.greedy_polygons(p, g, ["sample_id"], iou, cell), tiles, metrics.polygon_scores)


def report(scores: DataFrame) -> DataFrame:
    """name, mean: every measure's mean over the samples where it is finite, and parse_success_rate."""
    names = [c for c in scores.columns if c not in ("sample_id", "parse_ok_rate")]
    means = metrics.finite_means(scores.select(*(F.col(n).cast("double").alias(n) for n in names)), names)
    return means.unionByName(metrics.success_rate(scores.withColumnRenamed("parse_ok_rate", "rate")).select(F.lit("parse_success_rate").alias("name"), F.col("parse_success_rate").alias("mean")))


def predict_files(config: dict, answers: DataFrame, tiles: DataFrame, rasters: DataFrame, raster_crs: str, path: str, target_crs: str = geojson.C.CRS84) -> DataFrame:
    """A prediction from its configuration to files under ``path``: for each enabled task and each sample its collection, the answers as they came, and what each tile decoded to. ``answers``: sample_id, task, tile_index, text.
    Returns the summary, a row a sample and task: tile_count, decoded_ok_count, non_empty_tiles, n_final, output. A task that decodes nothing for a sample gets a file that says so instead of a collection, and after all files are written it is an error."""
    post = config.get("postprocess", {})
    state = config.get("state_update", {})
    steps = Steps(answers.sparkSession)
    told = None
    for task in C.enabled(C.load_tasks(config.get("serialization")), config):
        own = answers.where(F.lower("task") == task.name).select("sample_id", "tile_index", "text")
        p = predict(own, tiles, rasters, task.collection, raster_crs, None, int(state.get("border_margin_px", 96)), None, int(state.get("max_features", 32)), float(post.get("line_dedup_distance_m", 1.0)), None, task.geometry, task.min_points, float(post.get("polygon_dedup_iou", 0.5)))
        final = steps.kept(p.final, f"final-{task.name}")
        rates = metrics.parse_rates(p.tiles, ["sample_id"]).drop("rate")
        counts = final.groupBy("sample_id").agg(F.count("*").alias("n_final"))
        output = F.when(F.col("decoded_ok_count") > 0, F.lit(f"{task.collection}.geojson"))
        summary = rates.join(counts, "sample_id", "left").fillna(0, ["n_final"]).select("sample_id", F.lit(task.name).alias("task"), "tile_count", "decoded_ok_count", "non_empty_tiles", "n_final", output.alias("output"))
        told = steps.append(summary, "summary")
        collections = geojson.emit(final.join(rasters.select("sample_id", "a", "c", "e", "f"), "sample_id"), ["sample_id"], task.collection, task.geometry, raster_crs, target_crs)
        none = F.lit(geojson.empty(task.collection, target_crs))
        ok = summary.where("output is not null").select("sample_id").join(collections, "sample_id", "left").select("sample_id", F.lit(f"{task.collection}.geojson").alias("artifact"), F.coalesce("geojson", none).alias("text"))
        failed = summary.where("output is null").select("sample_id", F.lit(f"{task.collection}.parse_failed.json").alias("artifact"), F.to_json(F.struct("task", "tile_count", "decoded_ok_count", "non_empty_tiles")).alias("text"))
        raw = own.groupBy("sample_id").agg(prompts.raw_dump(F.col("tile_index"), F.col("text")).alias("text")).select("sample_id", F.lit(f"{task.collection}.raw_before_json.txt").alias("artifact"), "text")
        exports.write(ok.unionByName(failed).unionByName(raw), f"{path}/files/{task.name}")
        p.tiles.withColumn("task", F.lit(task.name)).write.mode("append").json(f"{path}/tiles")
    if told is None:
        raise C.CodedError("VL-1302", "no task is enabled")
    told.write.mode("overwrite").json(f"{path}/summary")
    silent = told.where("output is null").select("sample_id", "task").orderBy("sample_id", "task").limit(20).collect()
    if silent:
        raise C.CodedError("VL-1701", "nothing could be decoded for " + ", ".join(f"{r['task']} of {r['sample_id']}" for r in silent))
    return told
