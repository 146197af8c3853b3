"""Materialised intermediates in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: unlike cached
blocks these files outlive any executor, and rereading them starts a new plan.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is named and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rayscape-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    # without a scheme it belongs to the default file system, whichever that is
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Holds settings for the jobs run inside, then restores the session's own."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_batches(spark: SparkSession, rows: int = 2000, size: str = "4m") -> contextlib.AbstractContextManager[None]:
    """Bounds the Arrow batches of the jobs run inside."""
    return settings(spark, **{ARROW_ROWS: str(rows), ARROW_BYTES: size})


class Scratch:
    """A folder of named Parquet tables for one run of one operator."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(name)
        # a written table isn't computed again from its plan, so the plan's shuffle files can go at once
        with settings(self.spark, **{SHUFFLE_CLEANUP: "true"}):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def made(self, *prefixes: str) -> list[str]:
        """Names of the tables saved so far that begin so."""
        return [n for n in self.names if n.startswith(prefixes)]

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
