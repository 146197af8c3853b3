"""From receiver points and orbits to rays."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayscape.constants import LLA, MAXIMUM_ELEVATION, MINIMUM_ELEVATION, RAY_LENGTH, SATELLITES
from rayscape.functions import geodesy, gnss, planar
from rayscape.functions.time import utc_to_gps
from rayscape.operators import orbit


def constellation_sizes(points: DataFrame) -> DataFrame:
    """(constellation, n): first letters of the satellites at hand, and how many rows have each."""
    return points.filter("svid is not null").groupBy(F.substring("svid", 1, 1).alias("constellation")).agg(F.count("*").alias("n"))


def constellations_of(points: DataFrame) -> set[str]:
    """First letters of the satellites at hand; there are as many as letters at the most."""
    return {r[0] for r in constellation_sizes(points).collect()} if "svid" in points.columns else set()


def unsupported(svids: DataFrame) -> DataFrame:
    """Distinct constellation letters that aren't supported."""
    letter = F.substring("svid", 1, 1)
    return svids.filter(F.col("svid").isNotNull() & ~letter.isin(*SATELLITES)).select(letter.alias("constellation")).distinct()


def check_elevations(low: float, high: float) -> None:
    if not 0 <= low <= high <= 90:
        raise ValueError(f"elevations must have 0 <= {low} <= {high} <= 90")


def filter_elevation(observations: DataFrame, low: float = MINIMUM_ELEVATION, high: float = MAXIMUM_ELEVATION) -> DataFrame:
    """Geocentric rays whose elevation is from ``low`` to ``high`` degrees, ends included."""
    check_elevations(low, high)
    r, s = (tuple(F.col(f"{e}.{c}") for c in "xyz") for e in ("r", "s"))
    return observations.filter(geodesy.elevation(r, s).between(low, high))


def expand_channels(points: DataFrame) -> DataFrame:
    """GLONASS channels as a row for each slot they may be; the wrong one has no orbit or stands elsewhere. Others are unchanged."""
    return points.withColumn("svid", F.explode_outer(gnss.slots(F.col("svid"))))


def observe(points: DataFrame, orbits: DataFrame, constellations: set[str] | None = None, crs: str = LLA, low: float = MINIMUM_ELEVATION, high: float = MAXIMUM_ELEVATION, elevation: str | None = None) -> DataFrame:
    """All satellites over each receiver point, as geocentric rays, with the measurements of those that were received.

    ``points`` has time_ns, x, y, z and may have svid and measurement columns. Without ``constellations`` they are taken from svid; letters that
    aren't supported are left out with a warning. Each (place, time) is seen once; measurements that name one satellite twice fan out,
    and each row has an ``obs_id`` of its own: 128 bits of place, time, satellite and the measurement's number among its like. ``elevation`` names a column for the satellite's own elevation in degrees; the end of a ray, cut near its receiver, has too few digits to tell it.
    """
    measured = "svid" in points.columns
    wanted = set(constellations or ()) or constellations_of(points)
    if extra := wanted - set(SATELLITES):
        warnings.warn(f"constellations {sorted(extra)} are not supported", stacklevel=2)
    wanted &= set(SATELLITES)
    if not wanted:
        raise ValueError("no supported constellation is named, and none can be told from the points")
    placed = points.filter("time_ns is not null and x is not null and y is not null and z is not null")
    x, y, z = geodesy.to_crs(F.col("x"), F.col("y"), F.col("z"), crs, geodesy.ECEF)
    # places are told apart by their own coordinates, as they come: equal places have equal ones, and no hash can mix two up
    placed = placed.withColumns({"gps_ns": utc_to_gps(F.col("time_ns")), "place": F.struct("x", "y", "z")})
    sites = placed.select("gps_ns", "time_ns", "place", planar.point(x, y, z).alias("r")).dropDuplicates(["gps_ns", "place"])
    # the direction up is each site's own, so it is found once and not for every satellite
    known = geodesy.up_at(F.col("place.x"), F.col("place.y")) if geodesy.code(crs) == geodesy.code(LLA) else geodesy.up(tuple(F.col(f"r.{c}") for c in "xyz"))
    sites = sites.withColumn("up", planar.point(*known))
    allowed = gnss.is_supported(F.col("svid")) & F.substring("svid", 1, 1).isin(*sorted(wanted))
    sats = orbit.locate(orbit.candidates(sites, orbits, allowed), orbits).filter("sv_x is not null and sv_y is not null and sv_z is not null")
    seen = sites.join(sats.select("gps_ns", "svid", planar.point(F.col("sv_x"), F.col("sv_y"), F.col("sv_z")).alias("sat")), "gps_ns")
    away, r, s = (tuple(F.col(f"{e}.{c}") for c in "xyz") for e in ("up", "r", "sat"))
    # elevation needs nothing of the measurements, so it comes before their join
    check_elevations(low, high)
    seen = seen.withColumn("__elevation", geodesy.elevation_over(away, r, s)).filter(F.col("__elevation").between(low, high))
    seen = seen.withColumn("s", planar.point(*geodesy.cut_ray(r, s, RAY_LENGTH))).drop("sat", "up")
    seen = seen.withColumnRenamed("__elevation", elevation) if elevation else seen.drop("__elevation")
    key = ["gps_ns", "place", "svid"]
    if measured:
        seen = seen.join(numbered(expand_channels(placed).drop("time_ns", "x", "y", "z"), key), key, "left")
    else:
        seen = seen.withColumn("nth", F.lit(None).cast("int"))
    return seen.withColumn("obs_id", F.md5(F.to_json(F.struct(*key, "nth")).cast("binary"))).drop("gps_ns", "place", "nth")


def numbered(values: DataFrame, key: list[str]) -> DataFrame:
    """Measurements of one satellite at one place and time, such as those on two frequencies, with their number ``nth`` among them, by their values."""
    rest = [f.name for f in values.schema if f.name not in key and not isinstance(f.dataType, T.MapType)]
    order = [F.col(f"`{c}`") for c in rest] or [F.lit(0)]
    return values.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
