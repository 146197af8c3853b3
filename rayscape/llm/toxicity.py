"""A toxicity classifier that is regularised by counterfactuals.

Features are a document's words and the first four to eight bytes of each, as hashes; a
bounded sample of labelled documents settles which of them count. Weights minimise the
logistic loss, a ridge, and the mean squared change of the score's logit when an
identity term of a labelled sentence is swapped for another of its group: what a text says about
a group may count, which group it is may not. Scores are computed for whole texts, in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayscape.llm.arrowio import carried, slices
from rayscape.llm.hashing import CHUNK, U, mix, segment_hashes
from rayscape.llm.labelled import held_out, learnable, sample
from rayscape.llm.scratch import Scratch, arrow_batches

SAMPLE = 6000  # labelled documents of each class that are learned from at the most
FEATURES = 4096  # of the strongest, besides those of identity terms
SUPPORT = 4  # documents of the sample that a feature stands in at the least
PREFIXES = (4, 5, 6, 7, 8)  # bytes
RIDGE = 1e-4
COUNTERFACTUAL = 1.0
SWAPS = 3  # other terms that each term of a sentence is swapped for
STEPS = 400

# Groups of identity terms; within a group each may stand for any other.
IDENTITY = (
    ("man", "woman", "boy", "girl"),
    ("men", "women", "boys", "girls"),
    ("male", "female", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("american", "mexican", "chinese", "indian", "german", "french", "russian", "turkish"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("he", "she", "they"),
    ("him", "her", "them"),
    ("er", "sie"),
    ("il", "elle"),
    ("ils", "elles"),
    ("él", "ella"),
    ("ellos", "ellas"),
)
GROUP = {t: g for g in IDENTITY for t in g}
SENTENCE = re.compile(r"[^.!?\n]+")
TERM = re.compile(rf"\b(?:{'|'.join(GROUP)})\b")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def features(text: str) -> np.ndarray:
    """Distinct hashes of a text's words and prefixes, in order."""
    data = text.lower().encode("utf-8", "replace")
    found = []
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and _LETTER[data[end]]:
            end += 1
        buf = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[buf], [False]]).view(np.int8)))
        s, e = edges[::2], edges[1::2]
        if len(s):
            found.append(segment_hashes(buf, np.tile(s, 1 + len(PREFIXES)), np.concatenate([e, *(np.minimum(e, s + k) for k in PREFIXES)])))
            kinds = np.repeat(np.arange(1 + len(PREFIXES), dtype=U), len(s))
            keep = np.concatenate([np.full(len(s), True), *(e - s >= k for k in PREFIXES)])
            found[-1] = mix(found[-1] ^ kinds)[keep]
        at = end
    return np.unique(np.concatenate(found)) if found else np.zeros(0, U)


def swaps(text: str) -> Iterator[tuple[str, str]]:
    """(sentence, the same with an identity term swapped for another of its group)."""
    for m in SENTENCE.finditer(text.lower()):
        for term in TERM.finditer(m[0]):
            group = GROUP[term[0]]
            k = group.index(term[0])
            for other in [group[(k + j) % len(group)] for j in range(1, 1 + min(SWAPS, len(group) - 1))]:
                yield m[0], m[0][: term.start()] + other + m[0][term.end() :]


@lru_cache(maxsize=1)
def term_features() -> dict[str, np.ndarray]:
    return {t: features(t) for t in GROUP}


def swap_changes(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features gained, features lost) by each of ``swaps``, where there are any."""
    own = term_features()
    for m in SENTENCE.finditer(text.lower()):
        for term in TERM.finditer(m[0]):
            group, rest = GROUP[term[0]], features(m[0][: term.start()] + " " + m[0][term.end() :])
            k = group.index(term[0])
            for other in [group[(k + j) % len(group)] for j in range(1, 1 + min(SWAPS, len(group) - 1))]:
                gained, lost = (np.setdiff1d(own[x], np.concatenate([rest, own[y]])) for x, y in ((other, term[0]), (term[0], other)))
                if len(gained) + len(lost):
                    yield gained, lost


@dataclass
class Model:
    keys: np.ndarray  # hashes, in order
    weights: np.ndarray
    bias: float
    n_swaps: int = 0  # swapped terms of the sample that changed any feature

    def score(self, text: str) -> float:
        f = features(text)
        if len(self.keys) and len(f):
            at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            logit = self.bias + float(self.weights[at[self.keys[at] == f]].sum())
        else:
            logit = self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def descend(n: int, size: int, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, weight: np.ndarray, swap_rows: np.ndarray, swap_cols: np.ndarray, swap_signs: np.ndarray, times: np.ndarray, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample; (rows, cols) are the features present, and a kind of swap counts as often as it came."""
    w, bias = np.zeros(size), float(np.log((weight * y).sum() / max(1e-9, (weight * (1 - y)).sum())))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    share = times / max(1, times.sum())
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(rows, w[cols], n)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        r = weight * (p - y) / weight.sum()
        g = np.bincount(cols, r[rows], size) + RIDGE * w
        if len(times):
            change = share * np.bincount(swap_rows, swap_signs * w[swap_cols], len(times))
            g += 2 * penalty * np.bincount(swap_cols, swap_signs * change[swap_rows], size)
        gb = float(r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * (1 - step / (STEPS + 1))
        c, d = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-9)
        bias -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-9)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE, penalty: float = COUNTERFACTUAL) -> Model:
    """Fits a model on up to ``most`` labelled documents of each class, none of them held out.

    Null texts count as empty. Without labelled documents of both classes there is nothing to tell them by: the model then gives
    every text the share of toxic ones among the labels (none if there are no labels, so that nothing is rejected unheard).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = learnable(labels, label)
    share = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = sample(known, most)
    if len(share) < 2:
        rate = float(min(share, default=0))
        return Model(np.zeros(0, U), np.zeros(0), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    chosen = spark.createDataFrame(picked, f"__label_id {known.schema['__label_id'].dataType.simpleString()}, y int")
    # at most 2 * most rows
    rows = docs.select(docs[id_column].alias("__label_id"), F.coalesce(docs[text], F.lit("")).alias("__text")).join(F.broadcast(chosen), "__label_id")
    with arrow_batches(spark):
        rows = scratch.save(rows.select("__text", "y"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            ys = np.array(b.column("y").to_pylist())
            sets = [features(t) for t in b.column("__text").to_pylist()]
            every = np.concatenate(sets)
            keys, back = np.unique(every, return_inverse=True)
            y = np.repeat(ys, [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(back, y, len(keys)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(keys)).astype(np.int64))], ["key", "bad", "docs"])

    counts = rows.mapInArrow(count, "key bigint, bad bigint, docs bigint").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("docs").alias("docs"))
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, U), np.zeros(0), float(np.log(share[1] / share[0])))
    gap = F.col("bad") / n1 - (F.col("docs") - F.col("bad")) / n0
    strength = gap * gap / (F.col("docs") / (n1 + n0) * (1 - F.col("docs") / (n1 + n0 + 1)))
    known = scratch.save(counts.filter(F.col("docs") >= SUPPORT), "counts")
    best = known.orderBy(F.desc(strength), "key").select("key").limit(FEATURES).collect()
    # identity terms are always features, strong or not: what the sample says of them by chance is what swaps even out
    terms = np.unique(np.concatenate([features(t) for t in GROUP])).view(np.int64).tolist()
    best += known.filter(F.col("key").isin(terms)).select("key").collect()
    keys = np.unique(np.array([r.key for r in best], np.int64).view(U))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def at(f: np.ndarray) -> np.ndarray:
            where = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
            return where[keys[where] == f]

        for b in slices(batches, "__text"):
            out = []
            for t, y in zip(b.column("__text").to_pylist(), b.column("y").to_pylist()):
                out.append((y, at(features(t)).tolist(), None))
                for gained, lost in swap_changes(t):
                    gained, lost = at(gained), at(lost)
                    if len(gained) + len(lost):
                        out.append((None, gained.tolist(), lost.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())])], ["y", "plus", "minus"])

    got = scratch.save(rows.mapInArrow(present, "y int, plus array<int>, minus array<int>"), "present")
    data = sorted(got.filter("y is not null").select("y", "plus").collect(), key=lambda r: (r.y, r.plus))  # 2 * most rows
    # a swap changes the features of two terms only, so there are few kinds, however often and in however long texts they come
    changes = sorted(got.filter("y is null").groupBy("plus", "minus").agg(F.count("*").alias("n")).collect(), key=lambda r: (r.plus, r.minus))
    scratch.drop("sample", "counts", "present")
    y = np.array([r.y for r in data], float)
    weight = np.where(y == 1, share[1] / n1, share[0] / n0)
    flat = lambda lists: np.array([x for p in lists for x in p], np.int64)
    which = lambda lists: np.repeat(np.arange(len(lists)), [len(p) for p in lists])
    plus, minus = [r.plus for r in changes], [r.minus for r in changes]
    signs = np.concatenate([np.ones(len(flat(plus))), -np.ones(len(flat(minus)))])
    w, bias = descend(len(y), len(keys), which([r.plus for r in data]), flat([r.plus for r in data]), y, weight, np.concatenate([which(plus), which(minus)]).astype(np.int64), np.concatenate([flat(plus), flat(minus)]), signs, np.array([r.n for r in changes], float), penalty)
    return Model(keys, w, bias, sum(r.n for r in changes))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Each row's id and ``score``; with ``carry``, its text as ``__text`` and all other columns as a struct ``__row`` instead of the id. Null texts score as empty ones do.

    Rows are independent: repeated rows and ties are scored alike, and an empty table gives no rows.
    """
    rows = docs.select(carried(docs, id_column, text, carry).alias("__row"), docs[text].alias("__text"))
    names = ["__row", "__text"] if carry else ["__row"]
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            found = pa.array([model.score(t or "") for t in b.column("__text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], found], [*names, "score"])

    out = rows.mapInArrow(work, schema)
    return out if carry else out.withColumnRenamed("__row", id_column)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on the labels and scores every document: ``doc_id, held_out, score, predicted``.

    Null and empty texts have no features and score by the bias alone. Very long texts are scored whole, a chunk at a time. Repeated rows and
    ties score alike, rows with null ids are scored but not learned from, an empty table gives no rows, and other columns can have any name.
    """
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
