"""Android raw-measurement logs.

A log is text: comment lines (version and platform, and a heading for each kind of line) and then Raw, Fix and other
lines. Files are read by Spark in parallel; headings are one small row per file and kind.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayscape.constants import JOIN_TOLERANCE_MS, MINIMUM_PLATFORM, MINIMUM_VERSION
from rayscape.functions import gnss
from rayscape.operators.asof import discarded, receiver_positions
from rayscape.operators.features import process_raw
from rayscape.schemas import FIX, RAW

HEADING = r"^#\s*(Raw|Fix)\s*,"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, line_no, value) of every line; ``line_no`` grows within a log, without being consecutive."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("log_id"), "value")
    return text.select("log_id", F.monotonically_increasing_id().alias("line_no"), "value")


def header(text: DataFrame) -> DataFrame:
    """(log_id, version, platform) of each log, as written in its comments."""
    comment = text.filter(F.col("value").startswith("#"))
    pick = lambda word: F.nullif(F.regexp_extract(F.lower("value"), word + r":?\s*v?([^\s,]+)", 1), F.lit(""))
    return comment.groupBy("log_id").agg(F.max(pick("version")).alias("version"), F.upper(F.max(pick("platform"))).alias("platform"))


def check_header(head: DataFrame, version: str = MINIMUM_VERSION, platform: int = MINIMUM_PLATFORM) -> None:
    """A ValueError for logs of too old a version, a warning for too old a platform. One job over the headers."""
    old = F.coalesce(~gnss.version_at_least(F.col("version"), F.lit(version)), F.lit(True))
    odd = ~gnss.platform_at_least(F.col("platform"), platform)
    n_old, n_odd, which = head.agg(F.count_if(old), F.count_if(odd), F.min(F.when(old, F.col("log_id")))).first()
    if n_old:
        raise ValueError(f"{n_old} logs are of a version before {version}, such as {which}")
    if n_odd:
        warnings.warn(f"{n_odd} logs are of a platform before {platform}, or of one that can't be told", stacklevel=2)


def _fields(value: Column) -> Column:
    """Comma-separated fields after the first one, without blanks."""
    every = F.split(F.regexp_replace(value, r"[ \r]", ""), ",")
    return F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0)))


def _numbered(names: Column) -> Column:
    """Names in which a second occurrence has .1 after it, a third .2 and so on."""
    return F.transform(
        names,
        lambda n, i: F.when(F.size(F.filter(F.slice(names, 1, i), lambda m: m == n)) > 0, F.concat(n, F.lit("."), F.size(F.filter(F.slice(names, 1, i), lambda m: m == n)).cast("string"))).otherwise(n),
    )


def records(text: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
    """Lines of one kind as typed rows; fields are found by the log's own heading, absent or unreadable ones are NULL."""
    names = text.filter(F.col("value").rlike(HEADING) & (F.regexp_extract("value", HEADING, 1) == kind))
    names = names.groupBy("log_id").agg(F.max_by(_numbered(_fields(F.col("value"))), "line_no").alias("names"))
    places = names.select("log_id", F.array(*[F.array_position("names", f.name).cast("int") for f in schema]).alias("places"))
    rows = text.filter(F.col("value").startswith(f"{kind},")).select("log_id", "line_no", _fields(F.col("value")).alias("fields"))
    # one heading a log: far smaller than the log itself, and Spark checks its size before it broadcasts
    joined = rows.join(places, "log_id")

    def field(i: int, to: T.DataType) -> Column:
        known = F.nullif(F.get(F.col("fields"), F.get(F.col("places"), F.lit(i)) - 1), F.lit("NaN"))
        # whole numbers stay exact, and may be written with a decimal point
        return known.try_cast("decimal(38,9)").try_cast("bigint") if isinstance(to, T.LongType) else known.try_cast(to)

    return joined.select("log_id", "line_no", *[field(i, f.dataType).alias(f.name) for i, f in enumerate(schema)])


def read_raw_and_fix(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(raw, fix) of the logs at a path, which may be a folder or a pattern."""
    text = lines(spark, path)
    if check:
        check_header(header(text))
    return records(text, "Raw", RAW), records(text, "Fix", FIX)


def read_gnsslogger(spark: SparkSession, path: str, tolerance_ms: int = JOIN_TOLERANCE_MS, check: bool = True, count: bool = False) -> DataFrame:
    """Receiver points: each measurement with its satellite, times, pseudorange and the position fix nearest in time.

    With ``count``, one job counts the measurements that have no fix and are left out, and a warning tells how many.
    """
    raw, fix = read_raw_and_fix(spark, path, check)
    features = process_raw(raw)
    found = receiver_positions(features, fix, tolerance_ms)
    if count and (n := discarded(features, found).first()).discarded:
        warnings.warn(f"{n.discarded} of {n.measurements} measurements have no position fix near them", stacklevel=2)
    return found.withColumn("point_id", F.xxhash64("log_id", "line_no"))
