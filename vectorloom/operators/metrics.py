"""Scores of predictions, finite means, parse rates and training analytics."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rates(df: DataFrame) -> DataFrame:
    m = F.col("n_match")
    p, r = m / F.greatest(F.col("pred_count"), F.lit(1)), m / F.greatest(F.col("gt_count"), F.lit(1))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r <= 1e-9, 0.0).otherwise(2 * p * r / (p + r)))


def _counts(keys: DataFrame, pred: DataFrame, gt: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    out = keys.join(n(pred, "pred_count"), key, "left").join(n(gt, "gt_count"), key, "left").join(matches, key, "left")
    return out.fillna(0, ["pred_count", "gt_count", "n_match"])


def lane_scores(keys: DataFrame, pred: DataFrame, gt: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """key and ten measures; ``matches``: key, distance, endpoint_error, same_props. Means without a match are infinite."""
    m = matches.groupBy(key).agg(F.count("*").alias("n_match"), F.avg("distance").alias("d"), F.avg("endpoint_error").alias("e"), F.avg(F.col("same_props").cast("double")).alias("a"))
    out = _rates(_counts(keys, pred, gt, m, key))
    far = F.lit(float("inf"))
    return out.select(*key, "precision", "recall", "f1", F.coalesce("d", far).alias("mean_hausdorff"), F.coalesce("e", far).alias("mean_endpoint_error"), F.coalesce("a", F.lit(0.0)).alias("property_acc"), "pred_count", "gt_count", (F.col("pred_count") - F.col("n_match")).alias("unmatched_pred"), (F.col("gt_count") - F.col("n_match")).alias("unmatched_gt"))


def polygon_scores(keys: DataFrame, pred: DataFrame, gt: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """key and seven measures; ``matches``: key, iou, same_props."""
    m = matches.groupBy(key).agg(F.count("*").alias("n_match"), F.avg("iou").alias("i"), F.avg(F.col("same_props").cast("double")).alias("a"))
    out = _rates(_counts(keys, pred, gt, m, key))
    return out.select(*key, "precision", "recall", "f1", F.coalesce("i", F.lit(0.0)).alias("mean_iou"), F.coalesce("a", F.lit(0.0)).alias("property_acc"), "pred_count", "gt_count")


def finite_means(rows: DataFrame, measures: list[str]) -> DataFrame:
    """name and mean over finite values; names without one are left out."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    one = rows.agg(*(F.avg(finite(c)).alias(c) for c in measures))
    return one.unpivot([], measures, "name", "mean").where("mean is not null")


def parse_rates(tiles: DataFrame, key: list[str]) -> DataFrame:
    """key, tile_count, decoded_ok_count, non_empty_tiles and rate; ``tiles``: decoded_ok, n_features."""
    return tiles.groupBy(key).agg(F.count("*").alias("tile_count"), F.count_if("decoded_ok").alias("decoded_ok_count"), F.count_if(F.col("n_features") > 0).alias("non_empty_tiles")).withColumn("rate", F.col("decoded_ok_count") / F.col("tile_count"))


def success_rate(rates: DataFrame) -> DataFrame:
    """Mean of the keys' rates, each of equal weight."""
    return rates.agg(F.coalesce(F.avg("rate"), F.lit(0.0)).alias("parse_success_rate"))


def batches(items: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """Items (sample_id, tile_index, task_order, idx) with batch and place: per sample in that order, ``size`` at a time."""
    w = Window.partitionBy("sample_id")
    n = F.row_number().over(w.orderBy("tile_index", "task_order", "idx")) - 1
    out = items.withColumn("n", n).withColumn("batch", F.floor(F.col("n") / size).cast("long")).withColumn("place", (F.col("n") % size).cast("long"))
    if drop_last:
        out = out.withColumn("full", F.floor(F.count("*").over(w) / size)).where(F.col("batch") < F.col("full")).drop("full")
    return out.drop("n")


def batch_counts(items: DataFrame, size: int) -> DataFrame:
    return items.groupBy("sample_id").agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("long").alias("n_batches"))


def cosine_lr(step: Column, base: float, warmup: int, total: int) -> Column:
    """Linear to ``base`` over ``warmup`` steps, then half a cosine down to 0 at ``total``."""
    progress = F.least(F.greatest((step - warmup) / max(1, total - warmup), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, base * (step / max(1, warmup))).otherwise(base * 0.5 * (1 + F.cos(F.lit(math.pi) * progress)))


def shift_accuracy(tokens: DataFrame, key: list[str], ignore: int = -100) -> DataFrame:
    """key, n_valid, n_correct, accuracy: the prediction at a place against the label one further on (pos, predicted, label)."""
    nxt = F.lead("label").over(Window.partitionBy(*key).orderBy("pos"))
    t = tokens.withColumn("nxt", nxt).where(F.col("nxt").isNotNull() & (F.col("nxt") != ignore))
    return t.groupBy(key).agg(F.count("*").alias("n_valid"), F.count_if(F.col("predicted") == F.col("nxt")).alias("n_correct")).withColumn("accuracy", F.col("n_correct") / F.col("n_valid"))


def weighted_mean(rows: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(f"mean_{value}"))


def running_best(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with best so far and whether the row is a strict improvement."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("improved", before.isNull() | (F.col(value) < before)).withColumn("best", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_per(rows: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` (0: all) rows of each key: an export's cap."""
    if most <= 0:
        return rows
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("n", n).where(F.col("n") <= most).drop("n")


def padded(rows: DataFrame, key: list[str], tokens: str, pad: int) -> DataFrame:
    """``rows`` with the token array padded to its batch's longest, and a mask of true places."""
    wide = F.max(F.size(tokens)).over(Window.partitionBy(*key))
    gap = wide - F.size(tokens)
    fill = lambda v: F.array_repeat(F.lit(v), gap)
    return rows.withColumn("padded", F.concat(F.col(tokens), fill(pad))).withColumn("mask", F.concat(F.transform(F.col(tokens), lambda _: F.lit(1)), fill(0)))


@dataclass(frozen=True)
class Rule:
    """A step of a setting that costs memory: the setting's column, the test, its points, how the reason ends (None: with the setting's value), and advice."""

    setting: str
    test: Callable[[Column], Column]
    points: int | Callable[[Column], Column]
    told: str | None = None
    advice: str | None = None
    name: str | None = None


def _steps(setting: str, *steps: tuple, name: str | None = None) -> list[Rule]:
    """Rules of one setting of which at most one holds: the first whose test does."""
    out, before = [], []
    for test, *rest in steps:
        out.append(Rule(setting, (lambda test, earlier: lambda c: test(c) & ~reduce(lambda x, y: x | y(c), earlier, F.lit(False)))(test, tuple(before)), *rest, name=name))
        before.append(test)
    return out


def _over(n: int) -> Callable[[Column], Column]:
    return lambda c: c > n


def _from(n: int) -> Callable[[Column], Column]:
    return lambda c: c >= n


def _is(value) -> Callable[[Column], Column]:
    return lambda c: c == value


# Settings, thresholds, points and wording of the risk table.
RISKS = [
    *_steps("llm_train_mode", (_is("full"), 5, None, "switch to LoRA if possible"), (_is("lora"), 1)),
    *_steps("image_size", (_from(448), 3, None, "reduce image_size to 336 or 288"), (_from(384), 2), (_from(336), 1)),
    *_steps("target_max_tokens", (_is(0), 3, "unlimited", "set target_max_tokens to 1024 or lower"), (_over(1024), 2)),
    *_steps("state_max_tokens", (_is(0), 2, "unlimited", "set state_max_tokens to 512 or lower"), (_over(512), 1)),
    *_steps("prompt_max_tokens", (_is(0), 1, "unlimited")),
    *_steps("lane_max_features", (_is(0), 1, "unlimited", "cap lane.max_features"), (_over(64), 1), name="lane.max_features"),
    *_steps("intersection_max_features", (_is(0), 1, "unlimited", "cap intersection.max_features"), (_over(32), 1), name="intersection.max_features"),
    *_steps("state_max_features", (_over(16), 1), name="state_update.max_features"),
    *_steps("batch_size", (_over(1), lambda c: F.greatest(F.lit(2), c), None, "keep batch_size at 1")),
    *_steps("amp", (_is(False), 2, "false", "enable amp")),
    *_steps("gradient_checkpointing", (_is(False), 2, "false", "enable gradient checkpointing")),
]
LEVELS = {"high": 10, "medium": 6}


def memory_risk(runs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``runs`` (a column for each setting that the rules name) with score, the sum of the points of the rules that hold; level; reasons; and suggestions: the advice on each reason, each once, in the rules' order. Settings that are null count as 0, false or no mode."""
    rules = RISKS if rules is None else rules
    zero = {"string": "", "boolean": False}
    value = lambda r: F.coalesce(F.lower(F.trim(r.setting)) if runs.schema[r.setting].dataType.typeName() == "string" else F.col(r.setting), F.lit(zero.get(runs.schema[r.setting].dataType.typeName(), 0)))
    points = lambda r: r.points(value(r)) if callable(r.points) else F.lit(r.points)
    held = lambda of: F.filter(F.array(*(F.when(r.test(value(r)), of(r)) for r in rules)), lambda x: x.isNotNull())
    reason = lambda r: F.concat(F.lit(f"{r.name or r.setting}="), value(r).cast("string") if r.told is None else F.lit(r.told))
    out = runs.withColumn("score", reduce(lambda x, y: x + y, (F.when(r.test(value(r)), points(r)).otherwise(0) for r in rules), F.lit(0)).cast("long"))
    level = F.lit("low")
    for name, least in sorted(LEVELS.items(), key=lambda x: x[1]):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    return out.withColumn("level", level).withColumn("reasons", held(reason)).withColumn("suggestions", F.array_distinct(held(lambda r: F.lit(r.advice).cast("string"))))


def in_batches(items: DataFrame, size: int, numbers: list[int]) -> DataFrame:
    """The items of some of each sample's batches."""
    return batches(items, size).where(F.col("batch").isin(numbers))


def parameter_summary(parameters: DataFrame) -> DataFrame:
    """total, trainable and share of a model's values; ``parameters``: n_values, trainable."""
    out = parameters.agg(F.coalesce(F.sum("n_values"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("trainable"), F.col("n_values"))), F.lit(0)).alias("n_trainable"))
    return out.withColumn("share", F.round(F.col("n_trainable") / F.greatest("total", F.lit(1)), 6))


def stitched_counts(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, n_patch and n_stitched: features before and after near-duplicates go."""
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    return n(before, "n_patch").join(n(after, "n_stitched"), key, "left").fillna(0, ["n_stitched"])


def grouped_indices(items: DataFrame) -> DataFrame:
    """sample_id and its items' idx in the order of tile_index, task_order and idx."""
    rows = items.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("tile_index", "task_order", "idx"))).alias("all"))
    return rows.select("sample_id", F.transform("all", lambda x: x["idx"]).alias("indices"))


def best_tokens(scores: DataFrame, key: list[str], token: str, score: str) -> DataFrame:
    """key and the token with the greatest score, the least token if equal: greedy choice."""
    return scores.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(token).alias("t")))["t"].alias("token"))
