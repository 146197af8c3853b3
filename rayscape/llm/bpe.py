"""BPE encoding and decoding, with tree concatenation for long texts.

Short texts are encoded whole. A long text is halved until its pieces are short, the
pieces are encoded in parallel tasks, and neighbours are joined bottom-up, subtrees of GROUP pieces in
parallel tasks as well: a window
around each join is encoded anew, and grows until it shares two adjacent tokens (same
ids, same places) with the left piece and two with the right one. A sequence of BPE
tokens is the encoding of its text exactly if each adjacent pair is the encoding of
that pair's text; every pair of the joined sequence stands in a genuine encoding, so
the result equals the encoding of the whole text. If a window reaches both ends, it
is the whole text's encoding itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayscape.llm.arrowio import slices
from rayscape.llm.scratch import shuffle_width

LONG = 1 << 16  # characters; longer texts are halved
WINDOW = 64  # characters on each side of a join, to begin with
GROUP = 16  # pieces of a text that one task joins before the text's groups are joined
MEMO = 200_000  # words remembered by a task at the most


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


LETTER, NUMBER, BLANK = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"  # of Latin-1, in lower case
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{BLANK}{LETTER}{NUMBER}]+")


@lru_cache(maxsize=2)
def merger(path: str):
    """(a merger by ranks, ids by rank, token strings by id) for a tokenizer whose words end in ``</w>``; None if its merges can't be told by their results.

    A word is its bytes and a zero byte, which joins the last one before anything else.
    """
    import tiktoken

    model = json.loads(tokenizer(path).to_str())["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    back = {c: b for b, c in shown.items()}

    def raw(token: str) -> bytes:
        body = token.removesuffix(end)
        return bytes(back[c] for c in body) + b"\0" * (body != token)

    names = [shown[b] for b in range(256)] + [shown[b] + end for b in range(256)] + ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranks = {raw(n): k for k, n in enumerate(names)}
    if len(ranks) != len(names):
        return None
    strings = np.empty(max(vocab.values()) + 1, object)
    strings[list(vocab.values())] = list(vocab)
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), np.array([vocab[n] for n in names], "<u4"), strings


class WordMemo:
    """Encodes texts for tokenizers that drop white space, lower the case and let no token cross a word.

    Latin-1 texts are cut into words here and merged by rank; all others go to the library by their
    blank-separated stretches, each encoded once while remembered.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.merger = merger(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known: dict[str, tuple[bytes, str]] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > MEMO:
            self.known.clear()
        for w, e in zip(words, self.tok.encode_batch(words, add_special_tokens=False)):
            self.known[w] = np.asarray(e.ids, "<u4").tobytes(), self.tok.decode(e.ids, skip_special_tokens=False)

    def encode(self, text: str) -> tuple[bytes, str]:
        if self.merger and "\0" not in text and not any(x in text for x in self.special):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.by_stretches(text)
            merge, by_rank, strings = self.merger
            if not (words := WORD.findall(text.lower())):
                return b"", ""
            ids = by_rank[merge.encode_ordinary("\0".join(words) + "\0")]
            return ids.tobytes(), " ".join(strings[ids].tolist())
        return self.by_stretches(text)

    def by_stretches(self, text: str) -> tuple[bytes, str]:
        words = text.replace("\n", " ").split(" ")
        known = self.known
        if new := {w for w in words if w not in known}:
            if len(known) + len(new) > MEMO:
                new = set(words)
            self.learn(list(new))
            known = self.known
        found = [known[w] for w in words]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])


class Tokens:
    """Ids with their places in the text."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.ids, self.start, self.end = ids, start, end

    @classmethod
    def of(cls, tok, text: str, at: int = 0) -> Tokens:
        e = tok.encode(text, add_special_tokens=False)
        places = np.asarray(e.offsets, np.int64).reshape(-1, 2) + at
        return cls(np.asarray(e.ids, np.int64), places[:, 0], places[:, 1])

    def cut(self, a: int, b: int | None = None) -> Tokens:
        return Tokens(self.ids[a:b], self.start[a:b], self.end[a:b])

    def then(self, *more: Tokens) -> Tokens:
        every = [self, *more]
        return Tokens(*(np.concatenate([getattr(x, k) for x in every]) for k in ("ids", "start", "end")))


def shared_pairs(x: Tokens, y: Tokens, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(i, j) with x[i], x[i+1] the same as y[j], y[j+1] in ids and places, between low and high."""
    a, b = np.searchsorted(x.start, [low, high])
    place = {(int(x.ids[i]), int(x.start[i]), int(x.end[i])): i for i in range(a, min(b + 1, len(x.ids)))}
    rows = [place.get((int(y.ids[j]), int(y.start[j]), int(y.end[j])), -2) for j in range(len(y.ids))]
    for j in range(len(rows) - 1):
        i = rows[j]
        if i >= 0 and rows[j + 1] == i + 1 and x.start[i] < x.start[i + 1] and low <= x.start[i] and x.end[i + 1] <= high:
            yield i, j


def join(tok, text: str, left: Tokens, right: Tokens, low: int, at: int, high: int, window: int = WINDOW) -> Tokens:
    """Encoding of text[low:high] from those of text[low:at] and text[at:high]."""
    while True:
        a, b = max(low, at - window), min(high, at + window)
        mid = Tokens.of(tok, text[a:b], a)
        head, tail = (None, 0) if a == low else None, (len(mid.ids), None) if b == high else None
        if head is None:
            head = next(((i + 1, j + 1) for i, j in shared_pairs(left, mid, a, at)), None)
        if tail is None:
            tail = next(((j + 1, i + 1) for i, j in reversed(list(shared_pairs(right, mid, at, b)))), None)
        if head and tail and head[1] <= tail[0]:
            out = mid.cut(head[1], tail[0])
            before = left.cut(0, head[0]) if head[0] else left.cut(0, 0)
            after = right.cut(tail[1]) if tail[1] is not None else right.cut(0, 0)
            return before.then(out, after)
        window *= 2


def halves(n: int, most: int) -> list[int]:
    """Bounds of the pieces of a text of n characters, halved until each has at most ``most``."""
    parts = 1
    while n > parts * most:
        parts *= 2
    return [n * i // parts for i in range(parts + 1)]


def join_tree(tok, text: str, bounds: list[int], pieces: list[Tokens]) -> Tokens:
    """Joins neighbouring pieces pairwise, level by level."""
    while len(pieces) > 1:
        joined, edges = [], bounds[:1]
        for k in range(0, len(pieces) - 1, 2):
            joined.append(join(tok, text, pieces[k], pieces[k + 1], bounds[k], bounds[k + 1], bounds[k + 2]))
            edges.append(bounds[k + 2])
        if len(pieces) % 2:
            joined.append(pieces[-1])
            edges.append(bounds[-1])
        pieces, bounds = joined, edges
    return pieces[0]


def encode_by_tree(tok, text: str, most: int = LONG) -> list[int]:
    """The same on one machine."""
    bounds = halves(len(text), most)
    pieces = [Tokens.of(tok, text[a:b], a) for a, b in zip(bounds, bounds[1:])]
    return join_tree(tok, text, bounds, pieces).ids.tolist()


PIECE = ["__row", "__id", "k", "start", "part", "ids", "steps", "sizes"]


def packed(found: list[Tokens]) -> list[pa.Array]:
    """Ids, steps from one token's start to the next one's, and sizes of tokens, as bytes."""
    every = [[x.ids.astype("<u4").tobytes() for x in found], [np.diff(x.start, prepend=0).astype("<i4").tobytes() for x in found], [(x.end - x.start).astype("<i4").tobytes() for x in found]]
    return [pa.array(p, pa.binary()) for p in every]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """One row per row of ``docs``: its id, ``ids`` (little-endian unsigned 32-bit) and their ``decoded`` text.

    ``path`` names a word tokenizer's file, present on every executor; texts go through
    it unchanged, special tokens' strings included. A null or empty text has no ids and an
    empty decoding. A very long text's pieces are encoded and joined by many tasks; its ids are one value in the end, which one task holds. Repeated rows, ties, equal or null ids and columns of any other name are
    fine: rows are never matched by their ids.
    """
    rows = docs.select(docs[id_column].alias("__id"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"__id {kind}, ids binary, decoded string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(path)
        for b in slices(batches, "__text"):
            found = [memo.encode(t) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["__id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, i, t in zip(b.column("__row").to_pylist(), b.column("__id"), b.column("__text").to_pylist()):
                edges = halves(len(t), long)
                for k, (x, y) in enumerate(zip(edges, edges[1:])):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([i.as_py()], b.column("__id").type), pa.array([k], pa.int64()), pa.array([x], pa.int64()), pa.array([t[x:y]])], ["__row", "__id", "k", "start", "part"])

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in slices(batches, "part"):
            found = [Tokens.of(tok, t, a) for t, a in zip(b.column("part").to_pylist(), b.column("start").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("__row", "__id", "k", "start", "part")] + packed(found), PIECE)

    def joined(group: pd.DataFrame) -> tuple[Tokens, str, int]:
        """Encoding of a run of pieces, their text, and where it starts."""
        group = group.sort_values("start")
        first, body, pieces = int(group["start"].iloc[0]), "".join(group["part"]), []
        for r in group.itertuples():
            start = np.cumsum(np.frombuffer(r.steps, "<i4").astype(np.int64)) - first
            pieces.append(Tokens(np.frombuffer(r.ids, "<u4").astype(np.int64), start, start + np.frombuffer(r.sizes, "<i4")))
        return join_tree(tokenizer(path), body, [*(group["start"] - first).tolist(), len(body)], pieces), body, first

    def subtree(group: pd.DataFrame) -> pd.DataFrame:
        found, body, first = joined(group)
        found = Tokens(found.ids, found.start + first, found.end + first)
        out = group.iloc[:1][["__row", "__id", "k"]].assign(start=first, part=body)
        return out.assign(**dict(zip(PIECE[5:], [[x[0].as_py()] for x in packed([found])])))

    def whole_of_pieces(group: pd.DataFrame) -> pd.DataFrame:
        out = joined(group)[0].ids
        return pd.DataFrame({"__id": group["__id"].iloc[:1].array, "ids": [out.astype("<u4").tobytes()], "decoded": [tokenizer(path).decode(out.tolist(), skip_special_tokens=False)]})

    short = rows.filter(F.length("__text") <= long).mapInArrow(whole, schema)
    of_piece = f"__row bigint, __id {kind}, k bigint, start bigint, part string"
    tokens = of_piece + ", ids binary, steps binary, sizes binary"
    long_rows = rows.filter(F.length("__text") > long).select(F.monotonically_increasing_id().alias("__row"), "__id", "__text")
    # numbers are given, so that pieces and groups are spread over tasks however few bytes they weigh
    width = 4 * shuffle_width(docs.sparkSession)
    spread = long_rows.mapInArrow(cut, of_piece).repartition(width, "__row", "start").mapInArrow(piece, tokens)
    groups = spread.withColumn("__group", F.floor(F.col("k") / GROUP)).repartition(width, "__row", "__group").groupBy("__row", "__group").applyInPandas(subtree, tokens)
    joined_rows = groups.repartition(width, "__row").groupBy("__row").applyInPandas(whole_of_pieces, schema)
    return short.unionByName(joined_rows).withColumnRenamed("__id", id_column)
