"""Joins of rays and points with building footprints.

Rays are cut into the grid cells along their line, and buildings into those of their box, which makes the join an equality of
cells. A pair that meets in several cells is kept in one only: the first of the cells that both have, column by column. So
there is no distinct, and Spark can split crowded cells.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayscape.functions import diffraction, geodesy, planar

CELL = 100.0  # m


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def _spread(df: DataFrame, box: dict[str, Column], size: float, side: str) -> DataFrame:
    """A row for each cell that a row's box touches."""
    x, y = (F.sequence(_cell(box[f"min{c}"], size), _cell(box[f"max{c}"], size)) for c in "xy")
    out = df.withColumns({f"__{side}x": box["minx"], f"__{side}y": box["miny"], f"__{side}x2": box["maxx"], f"__{side}y2": box["maxy"]})
    whole = out.filter(box["minx"].isNotNull() & box["miny"].isNotNull() & box["maxx"].isNotNull() & box["maxy"].isNotNull())
    return whole.withColumn("__cx", F.explode(x)).withColumn("__cy", F.explode(y))


def _ray_box(r: Column, s: Column) -> dict[str, Column]:
    return {f"{n}{c}": pick(r[c], s[c]) for n, pick in (("min", F.least), ("max", F.greatest)) for c in "xy"}


def _columns(r: Column, s: Column, size: float) -> Column:
    """(column, first and last cell of the ray there, the same for the column before): all cells along a ray, column by column."""
    box = _ray_box(r, s)
    dx = s["x"] - r["x"]

    def span(c: Column) -> tuple[Column, Column]:
        # where the line enters and leaves the column; a hair of slack, since a cell too many costs nothing
        a, b = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge * F.lit(float(size)) - r["x"]) / F.nullif(dx, F.lit(0.0)))) for edge in (c, c + 1))
        ya, yb = (F.when(dx == 0, end["y"]).otherwise(r["y"] + t * (s["y"] - r["y"])) for t, end in ((a, r), (b, s)))
        return _cell(F.least(ya, yb) - F.lit(1e-6), size), _cell(F.greatest(ya, yb) + F.lit(1e-6), size)

    def cells(c: Column) -> Column:
        (low, high), (low_before, high_before) = span(c), span(c - 1)
        first = c == _cell(box["minx"], size)
        return F.struct(c.alias("c"), low.alias("low"), high.alias("high"), F.when(~first, low_before).alias("low_before"), F.when(~first, high_before).alias("high_before"))

    return F.transform(F.sequence(_cell(box["minx"], size), _cell(box["maxx"], size)), cells)


def pairs(rays: DataFrame, buildings: DataFrame, cell: float = CELL, keep: list[str] | None = None) -> DataFrame:
    """Every ray (ray_id, r, s, and columns to ``keep``) with each building (building_id, ring, height) whose box meets its own, once. Pairs whose boxes meet away from the ray's cells may be left out."""
    columns = ["ray_id", "r", "s", *(keep or [])]
    left = rays.select(*columns).filter("r.x is not null and r.y is not null and s.x is not null and s.y is not null")
    left = left.withColumn("__at", F.explode(_columns(F.col("r"), F.col("s"), cell))).withColumn("__cy", F.explode(F.sequence(F.col("__at.low"), F.col("__at.high"))))
    left = left.withColumn("__cx", F.col("__at.c"))
    right = _spread(buildings.select("building_id", "ring", "height"), planar.bounds(F.col("ring")), cell, "b")
    bx, by, by2 = _cell(F.col("__bx"), cell), _cell(F.col("__by"), cell), _cell(F.col("__by2"), cell)
    # a line's cells in a band of rows are consecutive columns: a pair's first one is where the column before has none of them
    met_before = (F.col("__cx") > bx) & (F.col("__at.low_before") <= by2) & (F.col("__at.high_before") >= by)
    home = ~F.coalesce(met_before, F.lit(False)) & (F.col("__cy") == F.greatest(by, F.col("__at.low")))
    box = _ray_box(F.col("r"), F.col("s"))
    touch = (F.col("__bx2") >= box["minx"]) & (F.col("__bx") <= box["maxx"]) & (F.col("__by2") >= box["miny"]) & (F.col("__by") <= box["maxy"])
    return left.join(right, ["__cx", "__cy"]).filter(touch & home).select(*columns, "building_id", "ring", "height")


def projected_height(rays: DataFrame, buildings: DataFrame, cell: float = CELL, keep: list[str] | None = None) -> DataFrame:
    """(ray_id, building_id, r, s, height, z, t, and columns to ``keep``): the lowest place at which each ray crosses each building's outline; pairs that don't cross are left out."""
    lowest = F.filter(F.array(planar.lowest_crossing(F.col("ring"), F.col("r"), F.col("s"))), lambda c: c.isNotNull())
    # as a generator it is computed once, and rows without a crossing go
    return pairs(rays, buildings, cell, keep).select("ray_id", "building_id", "r", "s", "height", *(keep or []), F.inline(lowest))


def height_matrix(heights: DataFrame, building_ids: list[int], row: str = "ray_id") -> DataFrame:
    """The wide form: a row per ray, a column per named building; NULL where they don't cross."""
    return heights.groupBy(row).pivot("building_id", building_ids).agg(F.min("z"))


def ray_hits(rays: DataFrame, buildings: DataFrame, cell: float = CELL) -> DataFrame:
    """(ray_id, building_id) where a ray meets a building at or below its height."""
    return projected_height(rays, buildings, cell).filter("z <= height").select("ray_id", "building_id")


def hits_all(rays: DataFrame, buildings: DataFrame, cell: float = CELL) -> DataFrame:
    """(ray_id, is_los): whether a ray hits every building there is, which is what ``is_los`` has always told; see ``clear_los``."""
    n = buildings.agg(F.count("*").alias("__n"))
    counts = ray_hits(rays, buildings, cell).groupBy("ray_id").agg(F.count("*").alias("__hits"))
    every = rays.select("ray_id").join(counts, "ray_id", "left").join(F.broadcast(n))  # one row
    return every.select("ray_id", (F.coalesce("__hits", F.lit(0)) == F.col("__n")).alias("is_los"))


def clear_los(rays: DataFrame, buildings: DataFrame, cell: float = CELL) -> DataFrame:
    """Rays that hit no building."""
    return rays.join(ray_hits(rays, buildings, cell).select("ray_id"), "ray_id", "left_anti")


def fresnel(rays: DataFrame, buildings: DataFrame, multi_edge: str = "all", cell: float = CELL) -> DataFrame:
    """(ray_id, fresnel): loss over the roofs that a ray passes below, lowest crossing first (Epstein-Peterson); 0 without any.

    ``multi_edge="first"`` counts only the hit building of the smallest id, as a map's first one.
    """
    if multi_edge not in ("all", "first"):
        raise ValueError(f"multi_edge {multi_edge} is not all or first")
    hit = projected_height(rays, buildings, cell).filter("z <= height")
    at = lambda c: F.col(f"r.{c}") + F.col("t") * (F.col(f"s.{c}") - F.col(f"r.{c}"))
    edge = planar.point(at("x"), at("y"), F.col("height"))
    # rows that are one ray under one id, such as measurements on two frequencies, share its edges
    key = ["ray_id", "r", "s"]
    if multi_edge == "first":
        edges = hit.groupBy(*key).agg(F.array(F.min_by(edge, "building_id")).alias("edges"))
    else:
        ordered = F.sort_array(F.collect_set(F.struct("z", "building_id", edge.alias("edge"))))
        edges = hit.groupBy(*key).agg(F.transform(ordered, lambda e: e["edge"]).alias("edges"))
    edges = edges.select(*[F.col(c).alias(f"__{c}") for c in key], "edges")
    found = rays.select(*key).join(edges, (F.col("ray_id") == F.col("__ray_id")) & (F.col("r") == F.col("__r")) & (F.col("s") == F.col("__s")), "left")
    return found.select("ray_id", F.when(F.col("edges").isNull(), F.lit(0.0)).otherwise(diffraction.chain_loss(F.col("r"), F.col("s"), F.col("edges"))).alias("fresnel"))


def inside_any(points: DataFrame, buildings: DataFrame, cell: float = CELL) -> DataFrame:
    """Ids of points that touch any building; its boundary counts."""
    x, y = F.col("x"), F.col("y")
    left = points.select("point_id", "x", "y").withColumns({"__cx": _cell(x, cell), "__cy": _cell(y, cell)})
    right = _spread(buildings.select("building_id", "ring"), planar.bounds(F.col("ring")), cell, "b")
    return left.join(right, ["__cx", "__cy"]).filter(x.between(F.col("__bx"), F.col("__bx2")) & y.between(F.col("__by"), F.col("__by2"))).filter(planar.contains(F.col("ring"), x, y, boundary=True)).select("point_id").distinct()


def outside(points: DataFrame, buildings: DataFrame, polygon: list[tuple[float, float]] | None = None, cell: float = CELL) -> DataFrame:
    """Points that touch no building and lie strictly within a polygon, if there is one."""
    if polygon:
        ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in polygon])
        points = points.filter(planar.contains(ring, F.col("x"), F.col("y")))
    return points.join(inside_any(points, buildings, cell), "point_id", "left_anti")


def ground_level(points: DataFrame) -> DataFrame:
    """Adds the ground's height, which is 0 until a terrain model is joined here."""
    return points.withColumn("ground", F.lit(0.0))


def reproject_rays(rays: DataFrame, source: str, target: str) -> DataFrame:
    if geodesy.code(source) == geodesy.code(target):
        return rays
    move = lambda c: planar.point(*geodesy.to_crs(F.col(f"{c}.x"), F.col(f"{c}.y"), F.col(f"{c}.z"), source, target))
    return rays.withColumns({"r": move("r"), "s": move("s")})


def reproject_map(buildings: DataFrame, source: str, target: str) -> DataFrame:
    """A map in another system: rings in the plane, heights as the reprojected height of the centre."""
    if geodesy.code(source) == geodesy.code(target):
        return buildings
    cx, cy = planar.centroid(F.col("ring"))
    out = buildings.withColumns({"height": geodesy.to_crs(cx, cy, F.col("height").cast("double"), source, target)[2]})

    def corner(c: Column) -> Column:
        x, y, _ = geodesy.to_crs(c["x"], c["y"], F.lit(0.0), source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return out.withColumn("ring", F.transform("ring", corner))


def drop_z(df: DataFrame) -> DataFrame:
    """Points without z, or a map whose corners are in the plane; a warning says so where there was a height."""
    corner = getattr(df.schema["ring"].dataType, "elementType", None) if "ring" in df.columns else None
    if corner is not None and "z" in corner.names:
        warnings.warn("corners have heights, which are dropped", stacklevel=2)
        return df.withColumn("ring", F.transform("ring", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))))
    if "z" in df.columns:
        warnings.warn("points have heights, which are dropped", stacklevel=2)
    return df.drop("z")
