"""As-of joins: each left row with the right row nearest in time.

No pairs are made: only different times are compared, of which a stretch as long as the tolerance has so many at the most,
however many rows share them. Time is cut into such stretches; each gets its own times, and of the one before and the one
after the nearest right time. A running last (or first) right time along a stretch is the match, and rows follow by an
equality join, which Spark can split. So neither a busy second nor a long log gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayscape.functions.time import floor_div


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col(f"`{name}`")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance: int, by: list[str] | None = None, order: str | None = None, direction: str = "nearest", how: str = "inner") -> DataFrame:
    """Joins each left row with its nearest right row within ``tolerance``, ends included.

    Both times are whole numbers in the same unit. On a tie the earlier right row wins, and of right rows at one time the one that is
    last by ``order``. ``direction`` is nearest, backward (right not after left) or forward. ``by`` names columns that must be equal.
    Rows without a time match nothing; with ``how="left"`` unmatched left rows stay, with nulls.
    """
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(f"direction {direction} is not nearest, backward or forward")
    by = by or []
    width = int(tolerance) + 1
    clash = (set(left.columns) & set(right.columns)) - set(by)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    fields = [c for c in right.columns if c not in by]
    by_cols = [quoted(c) for c in by]
    rows = right.filter(F.col(right_time).isNotNull()).select(*by_cols, F.struct(*[quoted(c) for c in fields]).alias("__right"), F.col(right_time).cast("long").alias("__u"), (F.col(order) if order else F.lit(0)).alias("__o"))
    # of the rows at one time only the last by order can win
    chosen = rows.groupBy(*by_cols, "__u").agg(F.min_by("__right", F.struct(F.lit(0) - F.col("__o"))).alias("__right"))
    keyed = left.withColumn("__t", F.col(left_time).cast("long"))
    asked = keyed.filter("__t is not null").select(*by_cols, floor_div(F.col("__t"), width).alias("__bucket"), "__t").distinct().withColumn("__u", F.lit(None).cast("long"))
    known = rows.select(*by_cols, floor_div(F.col("__u"), width).alias("__bucket"), "__u").distinct()
    ends = known.groupBy(*by_cols, "__bucket").agg(F.min("__u").alias("__first"), F.max("__u").alias("__last"))
    beside = ends.select(*by_cols, F.inline(F.array(F.struct((F.col("__bucket") - 1).alias("__bucket"), F.col("__first").alias("__u")), F.struct((F.col("__bucket") + 1).alias("__bucket"), F.col("__last").alias("__u")))))
    times = asked.unionByName(known.unionByName(beside).withColumn("__t", F.lit(None).cast("long")))
    along = Window.partitionBy(*by_cols, "__bucket").orderBy(F.coalesce("__t", "__u"))  # of equal times all are in the range's frame
    before, after = F.last("__u", ignorenulls=True).over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.last("__u", ignorenulls=True).over(Window.partitionBy(*by_cols, "__bucket").orderBy(F.coalesce("__t", "__u").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = lambda c: F.when(F.abs(F.col("__t") - F.col(c)) <= tolerance, F.col(c))
    found = times.withColumns({"__before": before, "__after": after}).filter("__t is not null").select(*by_cols, "__t", near("__before").alias("__before"), near("__after").alias("__after"))
    earlier = F.col("__after").isNull() | (F.col("__t") - F.col("__before") <= F.col("__after") - F.col("__t"))
    u = {"nearest": F.when(earlier, F.col("__before")).otherwise(F.col("__after")), "backward": F.col("__before"), "forward": F.col("__after")}[direction]
    # F.when with an unknown condition takes the other branch, so a missing earlier time gives the later one
    matches = found.select(*by_cols, "__t", u.alias("__u")).filter("__u is not null").join(chosen, [*by, "__u"]).select(*by_cols, "__t", "__right")
    joined = keyed.join(matches, [*by, "__t"], "left" if how == "left" else "inner")
    return joined.select(*[quoted(c) for c in left.columns], *[F.col("__right")[c].alias(c) for c in fields])


def receiver_positions(features: DataFrame, fix: DataFrame, tolerance: int) -> DataFrame:
    """Measurements with the position fix nearest to them; those without one are left out.

    Fixes without a place or a time, and measurements without one, take no part. The place comes as x (longitude), y (latitude), z (altitude).
    """
    places = fix.filter("Longitude is not null and Latitude is not null and Altitude is not null and `(UTC)TimeInMs` is not null")
    places = places.select("log_id", F.col("(UTC)TimeInMs").alias("fix_ms"), F.col("line_no").alias("fix_line"), F.col("Longitude").alias("x"), F.col("Latitude").alias("y"), F.col("Altitude").alias("z"))
    found = asof_join(features.filter("time_ms is not null"), places, "time_ms", "fix_ms", tolerance, by=["log_id"], order="fix_line")
    return found.drop("fix_ms", "fix_line", "time_ms")


def discarded(features: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how many measurements there are, how many have found a position, and how many were left out."""
    both = features.agg(F.count("*").alias("measurements")).join(F.broadcast(found.agg(F.count("*").alias("placed"))))  # a row each
    return both.withColumn("discarded", F.col("measurements") - F.col("placed"))
