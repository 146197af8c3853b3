"""Removal of word passages that occur more than once, found by difference-cover anchors.

A difference cover D modulo v holds, for any two positions, a shift below v that takes
both onto members of D. So if two windows of WINDOW words are equal, some pair of
equal anchors of WINDOW - v + 1 words stands at the same place in both, at positions
in D: only those positions need hashing (5 of 21). Windows that hold an anchor seen
twice are then extended to their full length and counted exactly, by 128-bit hashes.

Text travels in compressed blocks and hashes in packed arrays, each distinct value once per block, so a
passage that stands in a third of all documents costs its home task one entry per
block. What comes back to a block is a bit for each of its hashes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayscape.llm.arrowio import carried, slices, texts
from rayscape.llm.hashing import U, batch_word_hashes, window_hashes
from rayscape.llm.scratch import Scratch, arrow_batches, shuffle_width

PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # every difference modulo 21 is one of two members
WINDOW = 35  # words
BLOCK_BYTES = 1 << 20
GROUP_BYTES = 32 << 20  # hashes that one task compares at a time


# -- blocks ----------------------------------------------------------------------


def pack_texts(parts: list[bytes]) -> bytes:
    sizes = np.array([len(p) for p in parts], "<u8")
    return zstandard.ZstdCompressor(3).compress(struct.pack("<Q", len(parts)) + sizes.tobytes() + b"".join(parts))


def unpack_texts(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<Q", raw)
    edges = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u8", n, 8))]).astype(np.int64) + 8 + 8 * n
    return [raw[a:b] for a, b in zip(edges, edges[1:])]


def blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of (key, texts) as rows of (block, ids, compressed texts, words)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 33, 0
        for b in slices(batches, "__text", block_bytes):
            parts = texts(b.column("__text"))
            absent = [not x for x in b.column("__text").is_valid().to_pylist()]
            words = sum(len(p.split()) for p in parts)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("__row"))
            missing = pa.array([absent], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array([base + n]), ids, missing, pa.array([pack_texts(parts)], pa.binary()), pa.array([words])], ["block", "ids", "absent", "body", "words"])
            n += 1

    first = T.StructType.fromDDL("block bigint")
    return rows.mapInArrow(work, T.StructType([*first, T.StructField("ids", T.ArrayType(rows.schema["__row"].dataType)), *T.StructType.fromDDL("absent array<boolean>, body binary, words bigint")]))


# -- hashes of a block -------------------------------------------------------------


class Hashed:
    """Word hashes of a block, with each text's place among them."""

    def __init__(self, body: bytes):
        self.texts = unpack_texts(body)
        self.words, self.edges = batch_word_hashes(self.texts)
        n = len(self.words)
        counts = np.diff(self.edges)
        self.place = np.arange(n) - np.repeat(self.edges[:-1], counts)  # within the text
        self.after = np.repeat(self.edges[1:], counts) - np.arange(n)  # words from here to the text's end

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the anchors."""
        size = window - PERIOD + 1
        in_cover = np.zeros(PERIOD, bool)
        in_cover[list(COVER)] = True
        long_enough = (self.place + self.after) >= window
        at = np.flatnonzero(in_cover[self.place % PERIOD] & (self.after >= size) & long_enough)
        return at, window_hashes(self.words, size)[at] if len(at) else np.zeros(0, U)

    def candidates(self, window: int, anchors: np.ndarray) -> np.ndarray:
        """Starts of windows with one of these anchors at one of their first PERIOD words."""
        if not len(anchors):
            return np.zeros(0, np.int64)
        run = np.zeros(len(self.words) + PERIOD + 1, np.int64)
        run[anchors + 1] = 1
        np.cumsum(run, out=run)
        near = run[PERIOD : PERIOD + len(self.words)] - run[: len(self.words)] > 0
        return np.flatnonzero(near & (self.after >= window))

    def windows(self, window: int, at: np.ndarray) -> np.ndarray:
        """128-bit hashes of the windows that start there, as two columns."""
        if not len(at):
            return np.zeros((0, 2), U)
        return np.column_stack([window_hashes(self.words, window)[at], window_hashes(self.words, window, 0x27D4EB2F165667C5)[at]])


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in order, index of each row's distinct one, whether it occurs twice)."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort(h.T[::-1])
    s = h[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)])
    which = np.cumsum(new) - 1
    back = np.empty(len(h), np.int64)
    back[order] = which
    return s[new], back, np.bincount(which) > 1


# -- the exchange ------------------------------------------------------------------


def homes(found: np.ndarray, n: int) -> np.ndarray:
    """The group, of n, in which each hash is compared; ``found`` is sorted, so a group's hashes stand together."""
    return ((found[:, 0] >> U(32)) * U(n) >> U(32)).astype(np.int64)


def offers(block: int, h: np.ndarray, n: int) -> list[tuple[int, int, bytes, bytes]]:
    """(group, block, hashes, bits of those that the block itself holds twice) of a block's distinct hashes."""
    found, _, twice = distinct(h)
    home = homes(found, n)
    edges = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)] if len(home) else []
    return [(int(home[a]), block, found[a:b].tobytes(), np.packbits(twice[a:b]).tobytes()) for a, b in zip(edges, edges[1:])]


OFFER = "home bigint, block bigint, hashes binary, twice binary"


def offer_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], ["home", "block", "hashes", "twice"])


def repeats(offered: DataFrame, width: int) -> DataFrame:
    """For each block and group, bits of the hashes that occur twice anywhere, and how many; none where no hash does."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, U).reshape(-1, width) for x in group["hashes"]]
        sizes = [len(p) for p in parts]
        _, back, twice = distinct(np.concatenate(parts))
        own = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:k] for x, k in zip(group["twice"], sizes)])
        hit = twice[back] | own.astype(bool)
        edges = np.cumsum([0, *sizes])
        rows = [(b, int(group["home"].iloc[0]), np.packbits(hit[i:j]).tobytes(), int(hit[i:j].sum())) for b, i, j in zip(group["block"], edges, edges[1:]) if hit[i:j].any()]
        return pd.DataFrame(rows, columns=["block", "home", "bits", "hits"])

    marked = offered.groupBy("home").applyInPandas(compare, "block bigint, home bigint, bits binary, hits bigint")
    return marked.groupBy("block").agg(F.sum("hits").alias("hits"), F.map_from_entries(F.collect_list(F.struct("home", "bits"))).alias("marks"))


def marked(h: np.ndarray, marks: dict[int, bytes], n: int) -> np.ndarray:
    """Which of a block's hashes occur twice, from the bits that came back."""
    found, back, _ = distinct(h)
    if not len(found) or not marks:
        return np.zeros(len(h), bool)
    home = homes(found, n)
    hit = np.zeros(len(found), bool)
    edges = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
    for a, b in zip(edges, edges[1:]):
        if (bits := marks.get(int(home[a]))) is not None:
            hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8))[: b - a]
    return hit[back]


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Removes each word covered by a window whose words, in their order, also start anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input. Returns per row: its
    id, ``n_words``, ``n_removed``, ``kept`` (kept words joined by one space; the text itself, byte for
    byte, in ``kept_text`` where nothing was removed, null if it was null). A null text has no words. Repeated rows are each other's
    copies and lose every full window; a very long text is a block of its own, hashed a chunk at a time; equal or null ids are no matter, and an empty table
    gives no rows. Only the id and the text are read;
    with ``carry``, all other columns come along as a struct ``__row`` in place of the id.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    rows = docs.select(carried(docs, id_column, text, carry).alias("__row"), docs[text].alias("__text"))
    with arrow_batches(spark):
        cut = scratch.save(blocks(rows, block_bytes), "blocks")
    words = cut.agg(F.sum("words")).first()[0] or 0
    n = max(4 * shuffle_width(spark), -(-8 * words * len(COVER) // PERIOD // GROUP_BYTES))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in zip(b.column("block").to_pylist(), b.column("body")):
                _, h = Hashed(body.as_py()).anchors(window)
                yield offer_batch(offers(block, h.reshape(-1, 1), n))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body, marks in zip(b.column("block").to_pylist(), b.column("body"), b.column("marks").to_pylist()):
                block_of = Hashed(body.as_py())
                at, h = block_of.anchors(window)
                at = block_of.candidates(window, at[marked(h.reshape(-1, 1), dict(marks or []), n)])
                yield offer_batch(offers(block, block_of.windows(window, at), n2))

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__row", "n_words", "n_removed", "kept", "kept_text"]
        for b in batches:
            for k in range(b.num_rows):
                block_of = Hashed(b.column("body")[k].as_py())
                absent = b.column("absent")[k].as_py()
                at, h = block_of.anchors(window)
                at = block_of.candidates(window, at[marked(h.reshape(-1, 1), dict(b.column("marks")[k].as_py() or []), n)])
                at = at[marked(block_of.windows(window, at), dict(b.column("marks2")[k].as_py() or []), n2)]
                run = np.zeros(len(block_of.words) + 1, np.int64)
                np.add.at(run, at, 1)
                np.add.at(run, at + window, -1)
                gone = np.cumsum(run)[:-1] > 0
                out = []
                for t, i, j, none in zip(block_of.texts, block_of.edges, block_of.edges[1:], absent):
                    lost, split = gone[i:j], t.split()
                    removed = int(lost.sum())
                    if removed:
                        split = [w for w, x in zip(split, lost.tolist()) if not x]
                    kept = b" ".join(split)
                    out.append((j - i, removed, kept, None if none else kept if removed else t))
                cols = list(zip(*out))
                arrays = [b.column("ids")[k].values, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    with arrow_batches(spark, 8):
        seen = scratch.save(repeats(cut.select("block", "body").mapInArrow(first, OFFER), 1), "anchors")
        # an anchor opens PERIOD windows, and a window's hash is twice as wide
        hits = seen.agg(F.sum("hits")).first()[0] or 0
        n2 = max(4 * shuffle_width(spark), -(-16 * min(words, PERIOD * hits) // GROUP_BYTES))
        seen = seen.drop("hits")
        both = cut.select("block", "body").join(seen.hint("merge"), "block", "inner")
        again = scratch.save(repeats(both.mapInArrow(second, OFFER), 2).drop("hits"), "windows")
        every = cut.drop("words").join(seen.hint("merge"), "block", "left").join(again.withColumnRenamed("marks", "marks2").hint("merge"), "block", "left")
        out = scratch.save(every.mapInArrow(third, T.StructType([rows.schema["__row"], *T.StructType.fromDDL("n_words bigint, n_removed bigint, kept string, kept_text string")])), "kept")
    scratch.drop("blocks", "anchors", "windows")
    return out if carry else out.withColumnRenamed("__row", id_column)
