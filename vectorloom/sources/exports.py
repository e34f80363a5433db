"""Artifacts of a run as tables: a row holds a sample's or a tile's file and its text, and is written to a folder of its own."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import props as P
from ..operators.metrics import first_per
from .config import flag


@dataclass(frozen=True)
class Exports:
    """The ``artifact_export`` section: what is written, and how much of it (0: all)."""

    enabled: bool = False
    save_kept_patches: bool = True
    save_discarded_patches: bool = True
    save_resized_patch_inputs: bool = True
    save_train_batch_inputs: bool = True
    save_val_batch_inputs: bool = True
    save_train_batch_geojson: bool = True
    save_val_batch_geojson: bool = True
    save_train_batch_predictions: bool = False
    save_val_batch_predictions: bool = False
    save_eval_sample_geojson: bool = True
    save_predict_tile_geojson: bool = True
    max_batches_per_epoch: int = 1
    max_samples_per_batch: int = 1
    max_patch_images_per_sample: int = 0


def settings(config: dict) -> Exports:
    """Switches read as flags and limits as whole numbers; a setting that is not there keeps its default."""
    section = config.get("artifact_export", {})
    read = lambda f: flag(section[f.name], f.default) if isinstance(f.default, bool) else int(section[f.name])
    return Exports(**{f.name: read(f) for f in fields(Exports) if f.name in section})


def _artifact(rows: DataFrame, name: Column, text: Column) -> DataFrame:
    return rows.select("sample_id", name.alias("artifact"), text.alias("text"))


def audit(tiles: DataFrame) -> DataFrame:
    """Each sample's tile_audit.json: its audited tiles in candidate order, indented."""
    box = lambda p: F.array(*(F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")))
    one = F.struct("candidate_index", "selected", "reason", box("").alias("bbox"), box("keep_").alias("keep_bbox"), "mask_ratio", "mask_pixels")
    rows = tiles.groupBy("sample_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("json"))
    return _artifact(rows, F.lit("tile_audit.json"), P.indented_udf("json"))


def patches(tiles: DataFrame, choice: Exports) -> DataFrame:
    """Audited tiles whose image is to be written: selected and discarded ones as the switches say, the first of each sample up to the limit; ``folder`` tells the two apart."""
    wanted = tiles.where((F.col("selected") & F.lit(choice.save_kept_patches)) | (~F.col("selected") & F.lit(choice.save_discarded_patches)))
    kept = first_per(wanted, ["sample_id"], ["candidate_index"], choice.max_patch_images_per_sample)
    return kept.withColumn("folder", F.when(F.col("selected"), "selected").otherwise("discarded"))


def tile_files(answers: DataFrame, collections: DataFrame, task: str) -> DataFrame:
    """Files of each tile: the answer as it came (sample_id, tile_index, text), and its collections (sample_id, tile_index, kind, geojson) as predicted and as kept, indented."""
    place = lambda end: F.concat(F.lit(f"tile_geojson/{task}/"), F.format_string("tile_%04d.", "tile_index"), end)
    raw = _artifact(answers, place(F.lit("pred.raw.txt")), F.coalesce("text", F.lit("")))
    return raw.unionByName(_artifact(collections.where("geojson is not null"), place(F.concat("kind", F.lit(".geojson"))), P.indented_udf("geojson")))


def sample_files(collections: DataFrame, name: str) -> DataFrame:
    """A sample's collection files (sample_id, kind, geojson): kind is pred or gt."""
    return _artifact(collections, F.concat(F.lit(f"{name}."), F.col("kind"), F.lit(".geojson")), P.indented_udf("geojson"))


def batch_files(items: DataFrame, choice: Exports, stage: str) -> DataFrame:
    """Prompt, state, target and item files of the first samples of an epoch's first batches. ``items``: sample_id, task, batch, place, prompt, state, target, target_meta, state_items, target_items (JSON)."""
    if not choice.enabled or not getattr(choice, f"save_{stage}_batch_inputs"):
        return items.limit(0).select("sample_id", F.lit("").alias("artifact"), F.lit("").alias("text"))
    few = items.where((F.lit(choice.max_batches_per_epoch <= 0) | (F.col("batch") < choice.max_batches_per_epoch)) & (F.lit(choice.max_samples_per_batch <= 0) | (F.col("place") < choice.max_samples_per_batch)))
    files = {"prompt.txt": F.col("prompt"), "state.txt": F.col("state"), "target.txt": F.col("target"), "target_meta.txt": F.col("target_meta"), "state_items.json": P.indented_udf("state_items"), "target_items.json": P.indented_udf("target_items")}
    listed = F.array(*(F.struct(F.lit(k).alias("file"), F.coalesce(v, F.lit("")).alias("text")) for k, v in files.items()))
    rows = few.select("sample_id", F.format_string("%05d/%02d_%s_%s/", F.col("batch") + 1, "place", F.col("sample_id").cast("string"), "task").alias("folder"), F.explode(listed).alias("f"))
    return _artifact(rows, F.concat("folder", "f.file"), F.col("f.text"))


def failures(answers: DataFrame) -> DataFrame:
    """For answers without a collection (sample_id, tile_index, text, found): what came instead."""
    told = F.to_json(F.struct(F.lit(False).alias("parsed_geojson"), F.lit(0).alias("pred_feature_count"), F.coalesce("text", F.lit("")).alias("pred_text")))
    return _artifact(answers.where("found is null"), F.format_string("tile_%04d.pred.parse_failed.json", "tile_index"), P.indented_udf(told))


def write(artifacts: DataFrame, path: str) -> None:
    """A folder for each sample and artifact, with the text in one file; Spark's committer makes the write atomic."""
    artifacts.repartition("sample_id", "artifact").write.partitionBy("sample_id", "artifact").option("lineSep", "\n").mode("overwrite").text(path)
