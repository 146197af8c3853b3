"""Record types: their columns, and checks of their contents.

Receiver points, rays, observations and maps are DataFrames with fixed columns; a missing value is always NULL.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayscape.functions import geodesy

L, D, S = T.LongType(), T.DoubleType(), T.StringType()
POINT = T.StructType([T.StructField(c, D) for c in "xyz"])
CORNER = T.StructType([T.StructField(c, D) for c in "xy"])


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Field types of a receiver log, in the order of its header lines.
RAW = T.StructType([
    T.StructField(name, kind)
    for name, kind in (
        ("ElapsedRealtimeNanos", L), ("TimeNanos", L), ("LeapSecond", L), ("TimeUncertaintyNanos", D), ("FullBiasNanos", L),
        ("BiasNanos", D), ("BiasUncertaintyNanos", D), ("DriftNanosPerSecond", D), ("DriftUncertaintyNanosPerSecond", D),
        ("HardwareClockDiscontinuityCount", L), ("Svid", L), ("TimeOffsetNanos", D), ("State", L), ("ReceivedSvTimeNanos", L),
        ("ReceivedSvTimeUncertaintyNanos", L), ("Cn0DbHz", D), ("PseudorangeRateMetersPerSecond", D),
        ("PseudorangeRateUncertaintyMetersPerSecond", D), ("AccumulatedDeltaRangeState", L), ("AccumulatedDeltaRangeMeters", D),
        ("AccumulatedDeltaRangeUncertaintyMeters", D), ("CarrierFrequencyHz", D), ("CarrierCycles", L), ("CarrierPhase", D),
        ("CarrierPhaseUncertainty", D), ("MultipathIndicator", L), ("SnrInDb", D), ("ConstellationType", L), ("AgcDb", D),
        ("CarrierFrequencyHz.1", D), ("UserLatitude", D), ("UserLongitude", D), ("UserAltitude", D),
    )
])
FIX = T.StructType([
    T.StructField(name, kind)
    for name, kind in (
        ("Provider", S), ("Latitude", D), ("Longitude", D), ("Altitude", D), ("Speed", D), ("Accuracy", D),
        ("(UTC)TimeInMs", L), ("ElapsedRealtimeNanos", L),
    )
])

RAYS = struct(ray_id=L, r=POINT, s=POINT)
RECEIVER_POINTS = struct(point_id=L, time_ns=L, x=D, y=D, z=D)
OBSERVATIONS = struct(time_ns=L, svid=S, r=POINT, s=POINT)
MAP = struct(building_id=L, ring=T.ArrayType(CORNER), height=D)
SP3 = struct(epoch=L, date=S, time=L, svid=S, x=D, y=D, z=D, clockerror=D)
KINDS = {"rays": RAYS, "receiverpoints": RECEIVER_POINTS, "observations": OBSERVATIONS, "map": MAP}

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _fits(found: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(wanted, T.StructType):
        return isinstance(found, T.StructType) and [f.name for f in found] == [f.name for f in wanted] and all(_fits(a.dataType, b.dataType) for a, b in zip(found, wanted))
    if isinstance(wanted, T.ArrayType):
        return isinstance(found, T.ArrayType) and _fits(found.elementType, wanted.elementType)
    return isinstance(found, NUMBERS) if isinstance(wanted, NUMBERS) else type(found) is type(wanted)


def _contents(kind: str) -> dict[str, Column]:
    """What must hold of every row, by the failure's name."""
    whole = lambda c: F.col(f"{c}.x").isNotNull() & F.col(f"{c}.y").isNotNull() & F.col(f"{c}.z").isNotNull()
    rays = {"empty_rays": whole("r") & whole("s")}
    return {
        "rays": rays,
        "receiverpoints": {"missing_time": F.col("time_ns").isNotNull(), "empty_points": F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()},
        "observations": rays | {"missing_time": F.col("time_ns").isNotNull(), "missing_svid": F.col("svid").isNotNull()},
        "map": {"not_polygons": F.size("ring") >= 4, "open_rings": F.element_at("ring", 1) == F.element_at("ring", -1), "missing_height": F.col("height").isNotNull()},
    }[kind]


def failures(df: DataFrame, kind: str, contents: bool = True) -> list[str]:
    """Names of what is wrong with a record type's DataFrame; the columns first, then (in one job) the rows."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is not one of {sorted(KINDS)}")
    there = {f.name: f.dataType for f in df.schema}
    wrong = [f"column_{f.name}" for f in KINDS[kind] if f.name not in there or not _fits(there[f.name], f.dataType)]
    if wrong or not contents:
        return wrong
    rules = _contents(kind)
    held = df.agg(*(F.every(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items())).first()
    return [name for name in rules if held[name] is False]


def validate(df: DataFrame, kind: str, contents: bool = True) -> DataFrame:
    """The same DataFrame; an AttributeError names everything that is wrong with it."""
    if wrong := failures(df, kind, contents):
        raise AttributeError(f"not valid {kind}: {', '.join(wrong)}")
    return df


def infer_kind(df: DataFrame) -> str | None:
    """The most demanding record type whose columns a DataFrame has."""
    return next((k for k in ("observations", "map", "receiverpoints", "rays") if not failures(df, k, contents=False)), None)


def warn_of_plane_crs(crs: str) -> None:
    """A warning for a coordinate system without heights of its own."""
    if geodesy.is_2d(crs):
        warnings.warn(f"{crs} has no heights; they are carried along unchanged", stacklevel=2)


def warn_of_inexact_times(df: DataFrame, column: str = "time_ns") -> None:
    """A warning for nanoseconds kept as floating-point numbers, which can't hold them."""
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        warnings.warn(f"{column} is a floating-point column, which has too few digits for nanoseconds", stacklevel=2)
