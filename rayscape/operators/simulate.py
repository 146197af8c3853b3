"""Simulated receiver points and observations.

Random numbers are hashes of (seed, row, purpose), so a result doesn't depend on how rows are partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rayscape.constants import ECEF, LLA, SATELLITES, SECOND
from rayscape.functions import geodesy
from rayscape.operators import spatial
from rayscape.operators.observe import observe

CLUSTERS = ("none", "random", "levy", "guided")


def uniform(seed: int, purpose: str, *row: str) -> Column:
    """A number over 0 and under 1 for each row."""
    bits = F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *row), F.lit(1 << 52).cast("long"))
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(seed: int, purpose: str, *row: str) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(seed, purpose + "-r", *row)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, purpose + "-a", *row))


def exponential(seed: int, purpose: str, scale: float, *row: str) -> Column:
    return F.lit(-float(scale)) * F.ln(uniform(seed, purpose, *row))


def levy(seed: int, purpose: str, scale: float, *row: str) -> Column:
    z = normal(seed, purpose, *row)
    return F.lit(float(scale)) / (z * z)


def uniform_points(spark: SparkSession, bounds: tuple[float, float, float, float], n: int, seed: int = 0) -> DataFrame:
    """(parent, x, y) spread evenly over a box."""
    minx, miny, maxx, maxy = map(float, bounds)
    rows = spark.range(n).withColumnRenamed("id", "parent")
    return rows.select("parent", (F.lit(minx) + F.lit(maxx - minx) * uniform(seed, "x", "parent")).alias("x"), (F.lit(miny) + F.lit(maxy - miny) * uniform(seed, "y", "parent")).alias("y"))


def walk(starts: DataFrame, kind: str, speed: float, seed: int = 0) -> DataFrame:
    """(parent, step, x, y): from each (parent, x, y, duration), a step a second in a random direction; the first point is a step away."""
    if kind not in ("random", "levy"):
        raise ValueError(f"walk {kind} is not random or levy")
    steps = starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("duration") - 1)))
    length = F.lit(float(speed)) if kind == "random" else levy(seed, "length", speed, "parent", "step")
    angle = F.lit(2 * math.pi) * uniform(seed, "angle", "parent", "step")
    so_far = Window.partitionBy("parent").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = steps.withColumns({"dx": length * F.cos(angle), "dy": length * F.sin(angle)})
    return moved.withColumns({"x": F.col("x") + F.sum("dx").over(so_far), "y": F.col("y") + F.sum("dy").over(so_far)}).drop("dx", "dy", "duration")


def guided_walk(starts: DataFrame, endpoint: tuple[float, float], speed: float) -> DataFrame:
    """(parent, step, x, y): straight to an endpoint, a step a second, the last one at the endpoint itself."""
    ex, ey = map(float, endpoint)
    dx, dy = F.lit(ex) - F.col("x"), F.lit(ey) - F.col("y")
    far = F.sqrt(dx * dx + dy * dy)
    n = F.greatest(F.lit(1), F.ceil(far / F.lit(float(speed))).cast("int"))
    steps = starts.withColumns({"dx": dx, "dy": dy, "far": far, "n": n}).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = (F.col("step") + 1) * F.lit(float(speed)) / F.nullif(F.col("far"), F.lit(0.0))
    at_end = F.col("step") == F.col("n") - 1
    place = lambda c, end: F.when(at_end, F.lit(end)).otherwise(F.col(c) + part * F.col(f"d{c}"))
    return steps.withColumns({"x": place("x", ex), "y": place("y", ey)}).drop("dx", "dy", "far", "n")


def clusters(spark: SparkSession, bounds: tuple[float, float, float, float], start_ns: int, end_ns: int, n: int, cluster: str = "none", seed: int = 0, duration: float = 60.0, speed: float = 1.4, endpoint: tuple[float, float] | None = None) -> DataFrame:
    """(parent, step, time_ns, x, y): n parents in a box and a time span, each with a walk of a point a second (or alone)."""
    if cluster not in CLUSTERS:
        raise ValueError(f"cluster {cluster} is not one of {', '.join(CLUSTERS)}")
    parents = uniform_points(spark, bounds, n, seed)
    parents = parents.withColumn("time_ns", F.lit(start_ns).cast("long") + (F.lit(float(end_ns - start_ns)) * uniform(seed, "time", "parent")).cast("long"))
    if cluster == "none":
        return parents.withColumn("step", F.lit(0)).select("parent", "step", "time_ns", "x", "y")
    if cluster == "guided":
        if endpoint is None:
            raise ValueError("a guided walk needs an endpoint")
        moved = guided_walk(parents, endpoint, speed)
    else:
        moved = walk(parents.withColumn("duration", F.greatest(F.lit(1), F.ceil(exponential(seed, "duration", duration, "parent")).cast("int"))), cluster, speed, seed)
    return moved.withColumn("time_ns", F.col("time_ns") + F.col("step").cast("long") * F.lit(SECOND).cast("long")).select("parent", "step", "time_ns", "x", "y")


def point_process(buildings: DataFrame, bounds: tuple[float, float, float, float], start_ns: int, end_ns: int, n: int, receiver_offset: float = 1.0, **how) -> DataFrame:
    """Receiver points outside all buildings and strictly inside a box, ``receiver_offset`` above the ground."""
    minx, miny, maxx, maxy = map(float, bounds)
    points = clusters(buildings.sparkSession, bounds, start_ns, end_ns, n, **how).withColumn("point_id", F.xxhash64("parent", "step"))
    corners = [(maxx, maxy), (maxx, miny), (minx, miny), (minx, maxy), (maxx, maxy)]
    kept = spatial.ground_level(spatial.outside(points, buildings, corners))
    return kept.select("point_id", "time_ns", "x", "y", (F.col("ground") + F.lit(float(receiver_offset))).alias("z"))


def sample(observations: DataFrame, seed: int = 0, least: float = 10.0, mu: float = 35.0, noise: float = 5.0) -> DataFrame:
    """Adds Cn0DbHz: normal about mu less the diffraction loss, with ``noise`` as standard deviation; NULL unless over ``least``."""
    if "fresnel" not in observations.columns:
        raise AttributeError("observations need a column fresnel")
    strength = F.lit(float(mu)) - F.col("fresnel") + F.lit(float(noise)) * normal(seed, "strength", "obs_id")
    return observations.withColumn("Cn0DbHz", strength).withColumn("Cn0DbHz", F.when(F.col("Cn0DbHz") > least, F.col("Cn0DbHz")))


def simulate_observations(buildings: DataFrame, points: DataFrame, orbits: DataFrame, crs: str, constellations: set[str] | None = None, multi_edge: str = "all", **sampling) -> DataFrame:
    """What receivers at these points (in the map's system) would measure of every satellite above them."""
    x, y, z = geodesy.to_crs(F.col("x"), F.col("y"), F.col("z"), crs, LLA)
    placed = points.select("time_ns", x.alias("x"), y.alias("y"), z.alias("z"))
    seen = spatial.reproject_rays(observe(placed, orbits, constellations or set(SATELLITES)), ECEF, crs)
    loss = spatial.fresnel(seen.withColumnRenamed("obs_id", "ray_id"), buildings, multi_edge).withColumnRenamed("ray_id", "obs_id")
    return sample(seen.join(loss, "obs_id"), **sampling)


def simulate(buildings: DataFrame, orbits: DataFrame, bounds: tuple[float, float, float, float], start_ns: int, end_ns: int, n: int, crs: str, cluster: str = "none", cluster_args: dict | None = None, receiver_offset: float = 1.0, sampling_args: dict | None = None, seed: int = 0) -> DataFrame:
    """Points by ``point_process`` and their observations by all four constellations."""
    points = point_process(buildings, bounds, start_ns, end_ns, n, receiver_offset, cluster=cluster, seed=seed, **(cluster_args or {}))
    return simulate_observations(buildings, points, orbits, crs, **({"seed": seed} | (sampling_args or {})))


