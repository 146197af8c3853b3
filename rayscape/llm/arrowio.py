"""Small helpers for Arrow batches in ``mapInArrow``."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20


def _return_freed_memory() -> None:
    """Has large freed arrays go back to the system at once: workers live long, and an executor's memory holds several."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which otherwise grows with use
    pa.set_memory_pool(pa.system_memory_pool())


_return_freed_memory()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes at the most (or one row)."""
    for b in batches:
        if not b.num_rows:
            continue
        if (col := b.column(column)).nbytes <= most:
            yield b
            continue
        size = np.cumsum([len(x) if x is not None else 0 for x in map(_bytes, col)])
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield b.slice(at, to - at)
            at = to


def _bytes(x: pa.Scalar):
    return x.as_buffer() if x.is_valid and hasattr(x, "as_buffer") else None


def carried(docs: DataFrame, id_column: str, text: str, carry: bool) -> Column:
    """What of a row goes along with its text: its id, or (``carry``) a struct of all other columns, whatever their names."""
    if not carry:
        return docs[id_column]
    return F.struct(*[docs[c] for c in docs.columns if c != text], F.lit(0).alias("__none"))


def uncarried(docs: DataFrame, found: DataFrame, text: str, new: Column, measure: bool = True) -> DataFrame:
    """The columns of ``docs`` again, from rows of ``__row`` and results, with a new text (and, to ``measure``, its length as ``n_chars`` where there is that column)."""
    length = {"n_chars": F.length(new).cast("long")} if measure and "n_chars" in docs.columns else {}
    values = {c: F.col("__row")[c] for c in docs.columns if c != text} | {text: new} | length
    return found.select(*[values[c].alias(c) for c in docs.columns])


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` on each run of equal keys of batches sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            cut |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), b.num_rows]
        for i, j in zip(edges, edges[1:]):
            key = tuple(c[i] for c in cols)
            if held and key != last:
                yield from work(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield from work(pa.Table.from_batches(held))


def sorted_runs(df: DataFrame, n: int, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """Deals rows by ``keys`` to n tasks, sorts them there, and runs ``work`` on each key's rows."""
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: by_key(batches, keys, work), schema)
