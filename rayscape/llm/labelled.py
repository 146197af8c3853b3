"""Labelled rows for classifiers: the held-out split, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_column: Column) -> Column:
    """Whether a document is kept from learning: its id's CRC-32, as text, is 0 modulo 5. Null ids are kept from it too."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def learnable(labels: DataFrame, label: str, id_column: str = "doc_id") -> DataFrame:
    """(id, y) of the rows that may be learned from, one for each document; its greatest label where they differ."""
    rows = labels.filter(~held_out(F.col(id_column)) & F.col(label).isin(0, 1))
    return rows.groupBy(F.col(id_column).alias("__label_id")).agg(F.max(label).cast("int").alias("y"))


def sample(rows: DataFrame, most: int) -> list[tuple[int, int]]:
    """Up to ``most`` (id, y) of each label, the same ones every time."""
    out = []
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy(F.xxhash64("__label_id"), "__label_id").limit(most)
        out += [tuple(r) for r in part.select("__label_id", "y").collect()]
    return out
