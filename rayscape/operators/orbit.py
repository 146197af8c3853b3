"""Satellite orbits: windows of eight epochs, and positions by interpolation in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayscape.constants import SECOND
from rayscape.functions.geodesy import let
from rayscape.functions.time import doy_to_gps, floor_div, gps_to_doy

NODES = 8  # epochs of a window
BEFORE = 3  # of them before its middle
STEP = 4  # epochs from one window's middle to the next one's


def windows(sp3: DataFrame) -> DataFrame:
    """(date, svid, mid, lb, ub, t, x, y, z) per window, in GPS nanoseconds and metres; nodes as arrays.

    Middles stand at every fourth epoch from the fourth one on, and at the fifth from the end; a satellite with fewer than
    nine epochs in a day has no window.
    """
    by = Window.partitionBy("date", "svid")
    order = by.orderBy("t")
    frame = order.rowsBetween(-BEFORE, NODES - BEFORE - 1)
    rows = sp3.withColumn("t", doy_to_gps(F.col("date"), F.col("time")))
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(by)})
    rows = rows.withColumn("nodes", F.collect_list(F.struct("t", "x", "y", "z")).over(frame))
    last = F.col("n") - NODES + BEFORE
    chosen = (F.col("n") > NODES) & (((F.col("i") % STEP == BEFORE) & (F.col("i") < last)) | (F.col("i") == last))
    array = lambda c: F.transform("nodes", lambda p: p[c])
    kept = rows.filter(chosen).select("date", "svid", F.col("t").alias("mid"), *[array(c).alias(c) for c in ("t", "x", "y", "z")])
    return kept.withColumns({"lb": F.element_at("t", 1), "ub": F.element_at("t", -1)}).select("date", "svid", "mid", "lb", "ub", "t", "x", "y", "z")


def lagrange_weights(t: Column, nodes: Column, n: int = NODES) -> Column:
    """Weights of n values at t; times are whole nanoseconds, and differences of them are scaled to the window's length."""
    first = F.element_at(nodes, 1)
    span = (F.element_at(nodes, n) - first).cast("double")
    every = F.sequence(F.lit(0), F.lit(n - 1))

    def weights(u: Column, at: Column) -> Column:
        return F.transform(every, lambda j: F.aggregate(every, F.lit(1.0), lambda acc, k: F.when(k == j, acc).otherwise(acc * (u - F.get(at, k)) / (F.get(at, j) - F.get(at, k)))))

    return let({"u": (t - first).cast("double") / span, "at": F.transform(nodes, lambda x: (x - first).cast("double") / span)}, weights)


def weighted(weights: Column, values: Column) -> Column:
    """Sum of weighted values, about the first one, which keeps digits of large coordinates."""
    base = F.element_at(values, 1)
    return base + F.aggregate(F.zip_with(weights, values, lambda w, v: w * (v - base)), F.lit(0.0), lambda acc, x: acc + x)


def candidates(times: DataFrame, orbits: DataFrame, supported: Column | None = None) -> DataFrame:
    """(gps_ns, date, svid): the satellites that have an orbit on the day of each distinct time."""
    dated = times.select("gps_ns").filter("gps_ns is not null").distinct().withColumn("date", gps_to_doy(F.col("gps_ns"))[0])
    known = orbits.select("date", "svid").distinct()
    return dated.join(known if supported is None else known.filter(supported), "date")


BUCKET = 1800 * SECOND  # of time, in which times meet windows


def nearest_ranges(orbits: DataFrame) -> DataFrame:
    """Windows with the range of times, doubled, for which their middle is the nearest one (the later one on a tie), cut to the window itself."""
    order = Window.partitionBy("date", "svid").orderBy("mid")
    own = orbits.select("date", "svid", "mid", "lb", "ub", "t", "x", "y", "z")
    since, until = F.lag("mid").over(order) + F.col("mid"), F.col("mid") + F.lead("mid").over(order)
    return own.withColumns({"since": F.greatest(F.col("lb") * 2, F.coalesce(since, F.col("lb") * 2)), "until": F.least(F.col("ub") * 2 + 1, F.coalesce(until, F.col("ub") * 2 + 1))})


def locate(wanted: DataFrame, orbits: DataFrame) -> DataFrame:
    """Adds sv_x, sv_y, sv_z to rows of (gps_ns, date, svid): by the window of the nearest middle (the later one on a tie).

    NULL outside that window, and for satellites or days without orbits. Windows are put into the buckets of time in which theirs is the nearest middle, so
    that a time meets one or two of a day's windows and keeps one at the most.
    """
    keys = wanted.select("gps_ns", "date", "svid").distinct().withColumn("bucket", floor_div(F.col("gps_ns"), BUCKET))
    ranges = nearest_ranges(orbits).filter("since < until")
    spread = ranges.withColumn("bucket", F.explode(F.sequence(floor_div(F.col("since"), 2 * BUCKET), floor_div(F.col("until") - 1, 2 * BUCKET))))
    near = keys.join(spread, ["date", "svid", "bucket"]).filter((F.col("gps_ns") * 2 >= F.col("since")) & (F.col("gps_ns") * 2 < F.col("until")))
    near = near.withColumn("k", lagrange_weights(F.col("gps_ns"), F.col("t")))
    found = near.select("gps_ns", "date", "svid", *[weighted(F.col("k"), F.col(c)).alias(f"sv_{c}") for c in "xyz"])
    return wanted.join(found, ["gps_ns", "date", "svid"], "left")
