"""GeoJSON to and from pixel features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import lines as L

_TYPE = {"linestring": "LineString", "polygon": "Polygon"}


def read_text(spark, paths: str | list[str]) -> DataFrame:
    """path and text of whole files; a byte order mark goes."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def _affine() -> list[Column]:
    return [F.col("a"), F.lit(0.0), F.col("c"), F.lit(0.0), F.col("e"), F.col("f")]


def detect_crs(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.get_json_object(text, "$.crs.properties.name")), F.lit("")), F.lit(C.CRS84))


def ingest(texts: DataFrame, geometry: str, least: int, raster_crs: Column | str, source_crs: Column | str | None = None) -> DataFrame:
    """Rows of ``texts`` (text and the raster's a, c, e, f) as features: props (JSON) and line in pixels; for polygons rings, the outer first, without closing vertices.
    Features of another geometry, and those with too few points, go; texts that are no GeoJSON give none. Without ``source_crs`` each text's own system counts (``detect_crs``); either system may be a column."""
    if source_crs is None:
        texts, source_crs = texts.withColumn("_crs", detect_crs(F.col("text"))), F.col("_crs")
    out = ingest_elements(elements(texts), geometry, least, raster_crs, source_crs)
    return out.drop("_crs")


def elements(texts: DataFrame) -> DataFrame:
    """The features of collections (text) as source_index and feature, a text."""
    return texts.select(*(c for c in texts.columns if c != "text"), F.posexplode(F.from_json(F.get_json_object("text", "$.features"), "array<string>")).alias("source_index", "feature"))


def ingest_elements(features: DataFrame, geometry: str, least: int, raster_crs: Column | str, source_crs: Column | str) -> DataFrame:
    """``ingest`` of single features (feature)."""
    kind = F.lower(F.get_json_object("feature", "$.geometry.type"))
    rows = features.where(kind == geometry).withColumn("props", F.coalesce(F.get_json_object("feature", "$.properties"), F.lit("{}"))).withColumn("coordinates", F.get_json_object("feature", "$.geometry.coordinates"))

    def pixels(pts: Column) -> Column:
        def one(p: Column) -> Column:
            return L.let(C.projected(p[0], p[1], source_crs, raster_crs), lambda q: L.point(*C.world_to_pixel(q["x"], q["y"], _affine())))

        return F.transform(F.filter(pts, lambda p: F.size(p) >= 2), one)

    if geometry == "linestring":
        return rows.withColumn("line", pixels(F.from_json("coordinates", "array<array<double>>"))).where(F.size("line") >= least).drop("feature", "coordinates")
    deep = F.from_json("coordinates", "array<array<array<double>>>")
    # two levels: the polygon is one bare ring
    flat = F.array(F.from_json("coordinates", "array<array<double>>"))
    rings = F.transform(F.when(F.get_json_object("coordinates", "$[0][0][0]").isNull(), flat).otherwise(deep), pixels)
    close = lambda a, b: (F.abs(a["x"] - b["x"]) <= 1e-6) & (F.abs(a["y"] - b["y"]) <= 1e-6)
    opened = F.transform(rings, lambda r: F.when((F.size(r) > 1) & close(r[0], F.try_element_at(r, F.lit(-1))), F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(1)))).otherwise(r))
    whole = F.filter(opened, lambda r: F.size(r) >= 3)
    return rows.withColumn("rings", whole).where(F.size("rings") >= 1).withColumn("line", F.col("rings")[0]).where(F.size("line") >= least).drop("feature", "coordinates")


def _head(name: str, crs: str) -> str:
    return f'{{"type":"FeatureCollection","name":"{name}","crs":{{"type":"name","properties":{{"name":"{crs}"}}}},"features":['


def empty(name: str, crs: str = C.CRS84) -> str:
    """A collection without features."""
    return _head(name, crs) + "]}"


def _feature(geometry: str, raster_crs: Column | str, target_crs: str, with_z: bool) -> Column:
    """One feature's text, from props, line or rings, and the raster's a, c, e, f."""

    def place(p: Column) -> Column:
        world = L.let(F.struct(*(c.alias(n) for c, n in zip(C.pixel_to_world(p["x"], p["y"], _affine()), "xy", strict=True))), lambda w: C.projected(w["x"], w["y"], raster_crs, target_crs))
        return L.let(world, lambda q: F.array(q["x"], q["y"], F.lit(0.0)) if with_z else F.array(q["x"], q["y"]))

    if geometry == "linestring":
        body = F.to_json(F.transform(F.col("line"), place))
    else:
        body = F.to_json(F.transform(F.col("rings"), lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), place)))
    return F.concat(F.lit('{"type":"Feature","properties":'), F.col("props"), F.lit(f',"geometry":{{"type":"{_TYPE[geometry]}","coordinates":'), body, F.lit("}}"))


def emit(features: DataFrame, key: list[str], name: str, geometry: str, raster_crs: Column | str, target_crs: str = C.CRS84, with_z: bool = True) -> DataFrame:
    """key, geojson: one feature collection a key from features (props, line or rings, and the raster's a, c, e, f). Rings are closed again."""
    one = _feature(geometry, raster_crs, target_crs, with_z)
    head = _head(name, target_crs)
    rows = features.select(*key, F.struct("props", one.alias("f")).alias("one")).groupBy(key).agg(F.array_sort(F.collect_list("one")).alias("all"))
    return rows.select(*key, F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["f"]), ","), F.lit("]}")).alias("geojson"))


def emit_parts(features: DataFrame, key: list[str], name: str, geometry: str, raster_crs: Column | str, target_crs: str = C.CRS84, with_z: bool = True) -> DataFrame:
    """key, part (from 1), text, last: what ``emit`` says in parts of a feature each, so that no row holds a collection."""
    one = features.select(*key, "props", _feature(geometry, raster_crs, target_crs, with_z).alias("f"))
    order = Window.partitionBy(*key).orderBy("props", "f")
    rows = one.withColumns({"part": F.row_number().over(order).cast("long"), "last": F.lead(F.lit(True), 1, False).over(order) == F.lit(False)})
    text = F.concat(F.when(F.col("part") == 1, F.lit(_head(name, target_crs))).otherwise(","), "f", F.when(F.col("last"), "]}").otherwise(""))
    return rows.select(*key, "part", text.alias("text"), "last")


def write(collections: DataFrame, key: str, path: str, indent: bool = False) -> None:
    """One folder a key with its collection as text, indented if asked for; Spark's committer makes the write atomic."""
    from ..functions.props import indented_udf

    collections.select(key, (indented_udf("geojson") if indent else F.col("geojson")).alias("value")).write.partitionBy(key).mode("overwrite").text(path)
