"""Texts around a model's input and output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def task_prompt(meta: Column, example: Column, base: Column, rule: Column, has_state: Column) -> Column:
    """One line: place, example, task, output rule and, if there is state, a hint to it. Empty parts are left out."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" ", full(meta), full(example), full(base), full(rule), F.when(has_state, "Continue the features in the state."))


#: How a prompt ends with and without state, unless the configuration says otherwise.
WITH_STATE, WITHOUT_STATE = "Anchors of features that earlier patches cut follow; write down only what goes on here.", "No earlier patch has cut features of this one."


def configured(task, config: dict, meta: Column, has_state: Column) -> Column:
    """A task's prompt as the ``prompt`` section of a configuration wants it: the place (unless ``include_geospatial_context`` is off), the task's own text, and the suffix for tiles with and without state. ``task``: a ``config.Task``."""
    section = config.get("prompt", {})
    on = str(section.get("include_geospatial_context", True)).strip().lower() in ("true", "1", "yes", "on")
    ends = F.when(has_state, str(section.get("with_state_suffix", WITH_STATE)).strip()).otherwise(str(section.get("without_state_suffix", WITHOUT_STATE)).strip())
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" ", full(meta) if on else F.lit(None).cast("string"), full(F.lit(task.prompt)), full(ends))


def anchor_lines(items: Column) -> Column:
    """``idx=000 side=left points=..`` for each of an array of anchors (side, line)."""
    place = lambda p: F.concat(F.format_string("%.1f", p["x"]), F.lit(","), F.format_string("%.1f", p["y"]))
    return F.transform(items, lambda a, i: F.concat(F.format_string("idx=%03d", i), F.lit(" side="), a["side"], F.lit(" points="), F.array_join(F.transform(a["line"], place), ";")))


def state_text(items: Column, geojson: Column) -> Column:
    """Header, anchors and the state's GeoJSON; one word when there is none."""
    head = F.concat(F.lit("State anchors="), F.size(items).cast("string"))
    return F.when(F.size(items) == 0, F.lit("State none")).otherwise(F.array_join(F.concat(F.array(head), anchor_lines(items), F.array(F.concat(F.lit("StateGeoJSON "), geojson))), "\n"))


def cut_counts(cut_in: Column, cut_out: Column) -> tuple[Column, Column]:
    """Aggregates: features cut at their start and at their end."""
    return F.count_if(cut_in != "none"), F.count_if(cut_out != "none")


def target_text(items: Column, geojson: Column) -> Column:
    """Header, one line of cuts a feature, GeoJSON; for people to read."""
    one = lambda a, i: F.concat(F.format_string("idx=%03d", i), F.lit(" cut_in="), a["cut_in"], F.lit(" cut_out="), a["cut_out"])
    return F.array_join(F.concat(F.array(F.concat(F.lit("Targets features="), F.size(items).cast("string"))), F.transform(items, one), F.array(geojson)), "\n")


def raw_dump(index: Column, text: Column) -> Column:
    """Aggregate: the tiles' texts in order, each under its number."""
    rows = F.array_sort(F.collect_list(F.struct(index.alias("i"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.format_string("[tile %04d]\n", r["i"]), F.coalesce(r["t"], F.lit("")))), "\n")
