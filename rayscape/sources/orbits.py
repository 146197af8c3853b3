"""The store of orbit windows: Parquet, partitioned by date; JSON by day can be imported and exported."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayscape.operators.orbit import windows
from rayscape.sources import sp3

_D, _L = T.ArrayType(T.DoubleType()), T.LongType()
SCHEMA = T.StructType(
    [T.StructField("svid", T.StringType())]
    + [T.StructField(c, _L) for c in ("mid", "lb", "ub")]
    + [T.StructField("t", T.ArrayType(_L))]
    + [T.StructField(c, _D) for c in "xyz"]
    + [T.StructField("date", T.StringType())]
)
JSON = "map<string,map<string,struct<lb:bigint,ub:bigint,t:array<bigint>,x:array<double>,y:array<double>,z:array<double>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All stored windows; none where the store doesn't exist yet. A filter on date reads only its folders."""
    try:
        return spark.read.schema(SCHEMA).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def stored_dates(spark: SparkSession, path: str) -> DataFrame:
    """Days that the store holds."""
    return read(spark, path).select("date").distinct()


def write(orbits: DataFrame, path: str) -> None:
    """Stores windows; days that are there already are replaced, all others stay."""
    out = orbits.select(*SCHEMA.names).repartition("date").sortWithinPartitions("date", "svid", "mid")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def missing_dates(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct dates of ``wanted`` that aren't among ``stored``."""
    return wanted.select("date").distinct().join(stored.select("date"), "date", "left_anti")


def update(spark: SparkSession, path: str, source: DataFrame | str, dates: list[str] | None = None) -> DataFrame:
    """Adds windows for those days that the store doesn't hold, and returns the store.

    ``source`` is an SP3 table, or a local folder of SP3 files, of which each missing one of ``dates`` is read from its best product.
    """
    have = stored_dates(spark, path)
    if isinstance(source, str):
        missing = [r.date for r in missing_dates(spark.createDataFrame([(d,) for d in dates or []], "date string"), have).collect()]
        new = windows(sp3.read_available(spark, source, missing))
    else:
        new = windows(source.join(missing_dates(source, have), "date", "left_semi"))
    out = new.select(*SCHEMA.names).repartition("date").sortWithinPartitions("date", "svid", "mid")
    out.write.mode("append").partitionBy("date").parquet(path)
    return read(spark, path)


def export_json(orbits: DataFrame, path: str) -> None:
    """One JSON object a day, {svid: {mid: window}}, as lines of text in a folder for each date."""
    per_sat = orbits.groupBy("date", "svid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("mid").cast("string"), F.struct("lb", "ub", "t", "x", "y", "z"))))).alias("w"))
    day = per_sat.groupBy("date").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("svid", "w")))).alias("value"))
    day.write.mode("overwrite").partitionBy("date").text(path)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Windows from exported JSON."""
    text = spark.read.option("basePath", path).schema("value string, date string").text(path)
    sat = text.select(F.col("date").cast("string"), F.explode(F.from_json("value", JSON)).alias("svid", "w"))
    return sat.select("date", "svid", F.explode("w").alias("mid", "v")).select("date", "svid", F.col("mid").cast("long"), "v.*").select(*SCHEMA.names)
