"""GeoJSON in and out, and filtered reads of stored layers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rayscape.functions import planar

_POSITIONS = "array<array<double>>"


def read_map(spark: SparkSession, path: str, height: str = "height") -> DataFrame:
    """Buildings of GeoJSON files: polygons' outer rings (holes are left out) with their height."""
    feature = f"struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<{_POSITIONS}>>>"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"struct<features:array<{feature}>>").alias("g"))
    rows = text.select("file", F.posexplode("g.features").alias("pos", "f")).filter("f.geometry.type = 'Polygon'")
    ring = F.transform(F.element_at("f.geometry.coordinates", 1), lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))
    return rows.select(F.xxhash64("file", "pos").alias("building_id"), ring.alias("ring"), F.try_element_at("f.properties", F.lit(height)).try_cast("double").alias("height"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of GeoJSON files: their properties as a map of text, and x, y, z (NULL in the plane)."""
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<double>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<features:array<{feature}>>").alias("g"))
    rows = text.select(F.explode("g.features").alias("f")).filter("f.geometry.type = 'Point'")
    at = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    return rows.select(F.col("f.properties").alias("properties"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def ring_geometry(ring: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda c: F.array(c["x"], c["y"]))).alias("coordinates"))


def ray_geometry(r: Column, s: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.array(F.array(r["x"], r["y"], r["z"]), F.array(s["x"], s["y"], s["z"])).alias("coordinates"))


def point_geometry(x: Column, y: Column, z: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y, z).alias("coordinates"))


def write_features(df: DataFrame, geometry: Column, path: str, properties: list[str]) -> None:
    """Writes one GeoJSON feature a line, which many readers take as a sequence; Spark writes the parts in parallel."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def write_collection(df: DataFrame, geometry: Column, path: str, properties: list[str]) -> None:
    """Writes each partition as one GeoJSON FeatureCollection, a file that any reader takes."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))

    def collection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = '{"type":"FeatureCollection","features":['
        for b in batches:
            if b.num_rows:
                lines = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([before + lines[0], *("," + x for x in lines[1:])])], ["value"])
                before = ","
        if before == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

    df.select(feature.alias("value")).mapInArrow(collection, "value string").write.mode("overwrite").text(path)


def read_sequence(spark: SparkSession, path: str, properties: str, coordinates: str) -> DataFrame:
    """Reads what ``write_features`` wrote: properties and coordinates, by their given types."""
    text = spark.read.text(path).select(F.from_json("value", f"struct<properties:{properties},geometry:struct<type:string,coordinates:{coordinates}>>").alias("f"))
    return text.select("f.properties.*", F.col("f.geometry.coordinates").alias("coordinates"))


def read_layer(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, mask: list[tuple[float, float]] | None = None, rows: slice | None = None) -> DataFrame:
    """Buildings stored as Parquet with minx, miny, maxx, maxy: those that touch a box (pushed down to the scan), have a corner in a mask, and a run of them by id."""
    return layer(spark.read.parquet(path), bbox, mask, rows)


def layer(df: DataFrame, bbox: tuple[float, float, float, float] | None = None, mask: list[tuple[float, float]] | None = None, rows: slice | None = None) -> DataFrame:
    """The same of a table that is at hand."""
    if bbox:
        minx, miny, maxx, maxy = bbox
        df = df.filter((F.col("maxx") >= minx) & (F.col("minx") <= maxx) & (F.col("maxy") >= miny) & (F.col("miny") <= maxy))
    if mask:
        ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in mask])
        df = df.filter(F.exists("ring", lambda c: planar.contains(ring, c["x"], c["y"], boundary=True)))
    if rows:
        start = rows.start or 0
        df = df.orderBy("building_id").offset(start)
        df = df if rows.stop is None else df.limit(max(0, rows.stop - start))
    return df


def write_layer(buildings: DataFrame, path: str) -> None:
    """Stores buildings with their bounds, near ones together, so that scans by box skip files and row groups."""
    out = buildings.withColumns(planar.bounds(F.col("ring")))
    out.repartitionByRange("minx", "miny").sortWithinPartitions("minx", "miny").write.mode("overwrite").parquet(path)
