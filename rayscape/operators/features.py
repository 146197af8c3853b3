"""Raw log lines as satellite measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayscape.functions import gnss
from rayscape.functions.time import floor_div, gps_to_utc


def process_raw(raw: DataFrame) -> DataFrame:
    """Adds svid, receive and transmit times on the GPS scale, UTC time, milliseconds and the pseudorange; one projection, all rows kept."""
    letter = gnss.constellation(F.col("ConstellationType"))
    rx = F.col("TimeNanos") - F.col("FullBiasNanos")
    # the log's own Svid column is a number; names differ only by case, so it goes out of the way first
    out = raw.withColumnRenamed("Svid", "__number").withColumns({"svid": gnss.svid(letter, F.col("__number")), "rx": rx, "__letter": letter})
    out = out.withColumn("tx", gnss.transmit_time(F.col("rx"), F.col("ReceivedSvTimeNanos"), F.col("State"), F.col("__letter")))
    out = out.withColumns({"time_ns": gps_to_utc(F.col("rx")), "pr": gnss.pseudorange(F.col("rx"), F.col("tx"))})
    return out.withColumn("time_ms", floor_div(F.col("time_ns"), 1_000_000)).drop("__letter", "__number")


def pseudorange_report(features: DataFrame) -> DataFrame:
    """One row: least and greatest travel time in nanoseconds, and how many lie outside the plausible range (over 0, under a second)."""
    gap = F.col("rx") - F.col("tx")
    return features.agg(F.min(gap).alias("least"), F.max(gap).alias("greatest"), F.count_if((gap <= 0) | (gap >= 10**9)).alias("implausible"))
