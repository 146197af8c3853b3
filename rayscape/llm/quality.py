"""A quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Each text becomes a fixed number of statistics (size, words, characters by class,
repetition). Cosines of random projections of the standardised statistics approximate a
Gaussian kernel; every partition of the labelled rows sums its normal equations, and sums are added up FAN at a time, level by level, so
learning takes all labelled rows, and no task nor the driver more than FAN small matrices at once.
Ridge scores are calibrated by isotonic regression on a histogram of those of a fifth of the labelled rows, from which the ridge doesn't learn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayscape.llm.arrowio import slices, texts
from rayscape.llm.hashing import CHUNK, LOWER, SPACE, batch_word_hashes, segment_hashes, window_hashes
from rayscape.llm.labelled import held_out, learnable
from rayscape.llm.scratch import Scratch, arrow_batches, shuffle_width

FEATURES = 256
WIDTH = 0.5  # of the kernel, in standard deviations times the root of the number of statistics
RIDGE = 1e-4  # a labelled row
BINS = 1000
FAN = 16
FOLDS = 5  # of the labelled rows, one of which calibrates
SEED = 17

NAMES = ("log_bytes", "log_words", "mean_word", "std_word", "upper", "lower", "digit", "high", "blank", "line_rate", "stop", "comma", "bang", "bar", "symbol", "other", "distinct_words", "top_word", "same_next", "distinct_pairs", "distinct_lines", "repeated_line_bytes", "mark_words", "upper_words")

_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), (9, 11, 12, 13, 32), (10,), b".;:?\"'()", b",", b"!", b"|", b"#$%&*+<=>@\\^_`{}~[]/"), 1):
    _KIND[list(_chars)] = _k
KINDS = 12
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*+<=>@\\^_`{}~|!")] = True


def runs_of(values: np.ndarray) -> tuple[float, float]:
    """(share of distinct values, share of the most common one)."""
    if not len(values):
        return 0.0, 0.0
    _, n = np.unique(values, return_counts=True)
    return len(n) / len(values), n.max() / len(values)


def shape(data: bytes) -> tuple[np.ndarray, int, float, float, int, int]:
    """Counts of characters by kind, number of words, sum of their sizes and of the squares, words with marks, words of capitals; a chunk at a time."""
    kinds, n_words, sizes, squares, marked, capital = np.zeros(KINDS, np.int64), 0, 0.0, 0.0, 0, 0
    held = (0, 0, 0)  # size, marks and capitals of a word that the chunk's end cuts
    for at in range(0, len(data), CHUNK):
        buf = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at)
        kinds += np.bincount(_KIND[buf], minlength=KINDS)
        word = ~SPACE[buf]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        start, end = edges[::2], edges[1::2]
        size = end - start
        marks, upper = (np.diff(np.concatenate([[0], np.cumsum(x)])[edges])[::2] for x in (_MARKS[buf], (buf >= 65) & (buf <= 90)))
        if held[0] and word[0]:
            size[0], marks[0], upper[0] = size[0] + held[0], marks[0] + held[1], upper[0] + held[2]
        elif held[0]:
            size, marks, upper = (np.concatenate([[h], x]) for h, x in zip(held, (size, marks, upper)))
        held = (0, 0, 0)
        if word[-1] and at + CHUNK < len(data):
            held = int(size[-1]), int(marks[-1]), int(upper[-1])
            size, marks, upper = size[:-1], marks[:-1], upper[:-1]
        n_words, sizes, squares = n_words + len(size), sizes + float(size.sum()), squares + float((size.astype(float) ** 2).sum())
        marked, capital = marked + int((marks > 0).sum()), capital + int((upper == size).sum())
    return kinds, n_words, sizes, squares, marked, capital


def line_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes) of the lines that aren't empty; they tell lines of one text apart."""
    if len(data) <= CHUNK:
        buf = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(buf == 10)
        first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
        return segment_hashes(buf, first, last)[last > first], (last - first)[last > first]
    found = [(int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big"), len(x)) for x in data.split(b"\n") if x]
    return np.array([h for h, _ in found], np.uint64), np.array([k for _, k in found], np.int64)


def statistics(data: bytes, words: np.ndarray) -> list[float]:
    """The statistics named in NAMES, of a text and the hashes of its words. A long text takes some forty bytes a word, besides chunks."""
    n, w = len(data), len(words)
    if not w:
        return [math.log1p(n), *[0.0] * (len(NAMES) - 1)]
    counts, _, sizes, squares, marked, capital = shape(data)
    kinds, mean = counts / n, sizes / w
    lines, long = line_hashes(data)
    _, which, times = np.unique(lines, return_inverse=True, return_counts=True) if len(lines) else (0, np.zeros(0, int), np.zeros(0, int))
    again = long[times[which] > 1].sum() / n if len(lines) else 0.0
    share, top = runs_of(words)
    pairs, _ = runs_of(window_hashes(words, 2))
    return [
        math.log1p(n), math.log1p(w), mean, math.sqrt(max(0.0, squares / w - mean * mean)),
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], math.log1p(100 * kinds[6]), kinds[7], kinds[8], kinds[9], kinds[10], kinds[11], kinds[0],
        share, top, float((words[1:] == words[:-1]).mean()) if w > 1 else 0.0, pairs,
        len(times) / max(1, len(lines)), again,
        marked / w, capital / w,
    ]


def measured(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, statistics) of each row; null texts count as empty."""
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", 1 << 20):
            parts = texts(b.column("__text"))
            words, edges = batch_word_hashes([p.translate(LOWER) for p in parts])
            found = [statistics(p, words[i:j]) for p, i, j in zip(parts, edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(found, pa.list_(pa.float64()))], ["__id", "stats"])

    return docs.select(docs[id_column].alias("__id"), F.coalesce(docs[text], F.lit("")).alias("__text")).mapInArrow(work, f"__id {kind}, stats array<double>")


@dataclass
class Model:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # ridge scores
    heights: np.ndarray  # calibrated scores there

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        turn = rng.standard_normal((stats.shape[1], FEATURES)) / (WIDTH * math.sqrt(stats.shape[1]))
        phase = rng.uniform(0, 2 * math.pi, FEATURES)
        x = np.clip((stats - self.middle) / self.spread, -8, 8)
        return np.column_stack([np.ones(len(x)), math.sqrt(2 / FEATURES) * np.cos(x @ turn + phase), x / 8])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.heights)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Means of y, weighted by n, pooled until they don't fall."""
    level: list[list[float]] = []
    for a, b in zip(y.tolist(), n.tolist()):
        level.append([a, b, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            (p, q, k), (r, s, m) = level[-2], level[-1]
            level[-2:] = [[(p * q + r * s) / (q + s), q + s, k + m]]
    return np.concatenate([np.full(int(k), a) for a, _, k in level]) if level else np.zeros(0)


def added(sums: DataFrame, parts: int) -> np.ndarray:
    """Sum of packed arrays, one for each of about ``parts`` partitions, FAN at a time until there are no more than that."""

    def total(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": group["part"].iloc[:1] // FAN, "packed": [sum(np.frombuffer(x) for x in group["packed"]).tobytes()]})

    while parts > FAN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN).alias("__group")).applyInPandas(total, "part int, packed binary")
        parts = -(-parts // FAN)
    rows = sums.select("packed").collect()
    return sum(np.frombuffer(bytes(r.packed)) for r in rows) if rows else np.zeros(0)


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fits a model on all labelled rows that aren't held out: the ridge on four fifths, its calibration on the rest; ``stats`` is (__id, stats).

    Without any, every text scores a half.
    """
    from pyspark import TaskContext

    known = learnable(labels, label)
    calibrates = F.pmod(F.xxhash64("__label_id", F.lit(9)), F.lit(FOLDS)) == 0
    every = stats.join(known.hint("merge"), stats["__id"] == known["__label_id"]).select("stats", "y", calibrates.alias("calibrates"))
    rows, parts = every.filter("not calibrates"), shuffle_width(stats.sparkSession)
    size = len(NAMES)
    moments = rows.agg(F.count("*"), *(f(F.element_at("stats", i + 1)) for i in range(size) for f in (F.avg, F.stddev_pop))).first()
    model = Model(np.zeros(size), np.ones(size), np.zeros(1 + FEATURES + size), np.zeros(1), np.array([0.5]))
    if not moments[0]:
        return model
    model.middle = np.array(moments[1::2], float)
    model.spread = np.maximum(np.array(moments[2::2], float), 1e-6)
    width = 1 + FEATURES + size

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width + 1))
        for b in batches:
            if b.num_rows:
                z = model.features(np.array(b.column("stats").to_pylist()))
                out += z.T @ np.column_stack([z, b.column("y").to_numpy().astype(float)])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "packed"])

    both = added(rows.mapInArrow(equations, "part int, packed binary"), parts).reshape(width, width + 1)
    model.weights = np.linalg.solve(both[:, :-1] + RIDGE * moments[0] * np.eye(width), both[:, -1])

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, BINS))
        for b in batches:
            if b.num_rows:
                at = bins(model.raw(np.array(b.column("stats").to_pylist())))
                out[0] += np.bincount(at, minlength=BINS)
                out[1] += np.bincount(at, b.column("y").to_numpy().astype(float), BINS)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "packed"])

    n, hits = added(every.filter("calibrates").mapInArrow(histogram, "part int, packed binary"), parts).reshape(2, BINS)
    if not n.any():  # so few labels that none calibrates
        n, hits = added(rows.mapInArrow(histogram, "part int, packed binary"), parts).reshape(2, BINS)
    there = np.flatnonzero(n)
    model.steps = (there + 0.5) / BINS * 3 - 1
    # half a row of either label keeps scores off 0 and 1
    model.heights = isotonic((hits[there] + 0.5 * hits.sum() / n.sum()) / (n[there] + 0.5), n[there])
    return model


def bins(raw: np.ndarray) -> np.ndarray:
    """Bins of ridge scores from -1 to 2."""
    return np.clip(((raw + 1) / 3 * BINS).astype(np.int64), 0, BINS - 1)


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Per row: its id, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts are scored by their statistics, all of them zero; very long texts whole, a chunk at a time. Repeated rows and ties are scored
    alike; rows with null ids are scored but not learned from; an empty table gives no rows. Only the id and the text are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    with arrow_batches(spark):
        stats = scratch.save(measured(docs, id_column, text), "stats")
        model = train(stats, labels, label)
    kind = stats.schema["__id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = np.clip(model.score(np.array(b.column("stats").to_pylist())), 0, 1)
                yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(found)], ["__id", "score"])

    scored = stats.mapInArrow(work, f"__id {kind}, score double")
    return scored.select(F.col("__id").alias(id_column), held_out(F.col("__id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
