"""Best-fit packing of tokenized documents by patterns fitted to the length histogram.

Lengths are at most the sequence length, so their histogram is small whatever the
corpus. Patterns (one to three lengths that fill a sequence exactly) are fitted to it
by non-negative least squares; their counts are rounded down within the supply, and
what is left is packed largest first, each sequence completed as fully as the
remaining lengths allow, again a pattern at a time. The plan names, for every length, which run of
its pieces goes to which run of sequences. Pieces find their place by their rank
among the pieces of their length: their number among those of the partition that cut them, and how many came before in
other partitions, of which each partition has a small table in the shared folder. So ids are read and written in place, never
shuffled, and no task holds more than a batch of them.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rayscape.llm.arrowio import slices
from rayscape.llm.scratch import Scratch, arrow_batches

MAX_TOKENS = 1024
FIT_STEPS = 400
SMALL = 32  # lengths whose misfit weighs less: they fit anywhere
SMALL_WEIGHT = 0.3
STRETCH = 1 << 20  # characters that are encoded at a time, where a text can be cut
BLANKS = 4096  # white space in a row that is merged on its own: the encoder's pattern goes one level deeper for each character
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # white space as the encoder's pattern has it
PARTS = 256  # partitions whose tables of ranks share a file
BATCH_ROWS = 4096  # pieces in an Arrow batch


# -- plan ------------------------------------------------------------------------


def patterns(counts: np.ndarray, most: int) -> np.ndarray:
    """Exact fillings by one to three of the lengths present, as rows of three (zero: unused)."""
    there = np.flatnonzero(counts)
    there = there[there > 0]
    has = counts > 0
    out = [[most, 0, 0]] if has[most] else []
    out += [[a, most - a, 0] for a in there if a < most <= 2 * a and has[most - a]]
    for a in there[there < most]:
        b = there[(there <= a) & (2 * there >= most - a) & (there < most - a)]
        b = b[has[most - a - b]]
        out.extend(np.column_stack([np.full(len(b), a), b, most - a - b]).tolist())
    return np.array(out, np.int64).reshape(-1, 3)


def fit(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 of the patterns with least weighted squares of (use of lengths - counts); accelerated projected gradient."""
    size = len(counts)
    weight = np.where(np.arange(size) <= SMALL, SMALL_WEIGHT, 1.0)
    weight[0] = 0
    use = lambda x: sum(np.bincount(rows[:, k], x, size) for k in range(3))
    back = lambda r: sum(r[rows[:, k]] for k in range(3))
    v = np.ones(len(rows))
    for _ in range(30):  # largest eigenvalue, for the step
        v = back(weight * use(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(FIT_STEPS):
        new = np.maximum(0, y - back(weight * (use(y) - counts)) / (1.05 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def reach(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, within their counts, of the greatest sum up to ``room``; larger lengths are used first."""
    by = [1]  # sums that can be reached with the lengths so far, as bits
    order = np.flatnonzero(counts[: room + 1])[::-1]
    full = (1 << (room + 1)) - 1
    used = []
    for n in order:
        bits, left = by[-1], min(int(counts[n]), room // int(n))
        step = 1
        while left > 0:  # 1, 2, 4 ... copies
            k = min(step, left)
            bits |= (bits << (k * int(n))) & full
            left -= k
            step *= 2
        by.append(bits)
        used.append(int(n))
        if bits >> room & 1:
            break
    at = by[-1].bit_length() - 1
    out = []
    for n, before in zip(reversed(used), reversed(by[:-1])):
        while not before >> at & 1:
            out.append(n)
            at -= n
    return out


def plan(counts: np.ndarray, most: int = MAX_TOKENS) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) for all pieces; ``counts[n]`` of them have length n."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []

    def take(lengths: list[int], repeats: int) -> None:
        for n in lengths:
            left[n] -= repeats
        out.append((lengths, repeats))

    rows = patterns(left, most)
    if len(rows):
        x = fit(rows, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            lengths = [int(n) for n in rows[i] if n]
            each = {n: lengths.count(n) for n in lengths}
            if repeats := min(int(x[i]), *(int(left[n]) // k for n, k in each.items())):
                take(lengths, repeats)
    for big in range(most, 0, -1):
        while left[big] > 0:
            left[big] -= 1
            rest = reach(left, most - big)
            left[big] += 1
            lengths = [big, *rest]
            each = {n: lengths.count(n) for n in lengths}
            take(lengths, min(int(left[n]) // k for n, k in each.items()))
    return out


def runs(planned: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan by length: ranks from ``rank`` on of ``length`` go, one each, to sequences from ``sequence`` on, at ``offset``."""
    rows, used, sequence = [], {}, 0
    for lengths, repeats in planned:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + repeats
            offset += n
        sequence += repeats
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": cols[:, 0], "rank": cols[:, 1], "sequence": cols[:, 2], "offset": cols[:, 3]}


# -- pieces ----------------------------------------------------------------------


@lru_cache(maxsize=2)
def library_encoder(json_path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(json_path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=2)
def rank_encoder(json_path: str, ranks_path: str):
    """A faster encoder of the same vocabulary, the ids of special tokens by their strings, and a pattern that cuts these out; None if they take blanks along."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    special = {t["content"]: t["id"] for t in added}
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special, cut


def stretches(text: str, most: int = STRETCH, blanks: int = BLANKS) -> Iterator[tuple[str, bool]]:
    """A text in parts that are encoded on their own, and whether a part is one run of white space.

    No token reaches from a character into white space after it, and a run of white space is one token's text but for its
    last character, which may begin the next one's. So texts can be cut before white space, and a run before its last character.
    """
    if len(text) <= blanks:
        yield text, False
        return
    at = 0
    for m in re.finditer(f"(?<![{WHITE}])[{WHITE}]{{{blanks + 1},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        yield from ((x, False) for x in before_blanks(text, at, m.start(), most))
        yield text[m.start() : end], True
        at = end
    yield from ((x, False) for x in before_blanks(text, at, len(text), most))


def before_blanks(text: str, at: int, end: int, most: int) -> Iterator[str]:
    """text[at:end] in parts of about ``most`` characters, each cut between a character and white space after it."""
    edge = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
    while end - at > most:
        m = edge.search(text, at + most, end)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < end:
        yield text[at:end]


def ids_of(text: str, json_path: str, ranks_path: str | None) -> np.ndarray:
    """Token ids as the library gives them, special tokens' strings included."""
    found = rank_encoder(json_path, ranks_path) if ranks_path else None
    if not found:
        return np.array(library_encoder(json_path).encode(text, add_special_tokens=False).ids, "<u4")
    fast, special, cut = found
    out: list[np.ndarray] = []

    def plain(part: str) -> None:
        for x, blank in stretches(part):
            out.append(np.array(fast._encode_single_piece(x) if blank else fast.encode_ordinary(x), "<u4"))

    at = 0
    if cut and any(x in text for x in special):
        for m in cut.finditer(text):
            plain(text[at : m.start()])
            out.append(np.array([special[m[0]]], "<u4"))
            at = m.end()
    plain(text[at:] if at else text)
    return out[0] if len(out) == 1 else np.concatenate(out)


def bounds(n: int, most: int) -> list[int]:
    """Where a document of n tokens is cut: not at all up to ``most``, else into full pieces after a first one that may be shorter."""
    if n <= most:
        return [0, n]
    first = n % most or most
    return [0, *range(first, n + 1, most)]


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None, id_column: str, text: str, end_id: int, most: int, with_ids: bool) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"__id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + (", ids binary" if with_ids else "")

    names = ["__id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, *cols = zip(*rows)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (most + 1)
        end = np.array([end_id], "<u4")
        for b in slices(batches, "__text"):
            rows = []
            for i, t in enumerate(b.column("__text").to_pylist()):
                body = np.concatenate([ids_of(t, json_path, ranks_path), end])
                edges = bounds(len(body), most)
                for k, (x, y) in enumerate(zip(edges, edges[1:])):
                    rows.append((i, k, x, y - x, zlib.crc32(body[x:y]), part, seen[y - x], *([body[x:y].tobytes()] * with_ids)))
                    seen[y - x] += 1
                    if len(rows) == BATCH_ROWS:
                        yield batch(b.column("__id"), rows)
                        rows = []
            if rows:
                yield batch(b.column("__id"), rows)

    rows = docs.select(docs[id_column].alias("__id"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    return rows.mapInArrow(work, schema)


def write_ranks(each: DataFrame, folder: str, most: int) -> dict[int, str]:
    """Writes, for every partition, how many pieces of each length come before its own; returns the files' names by number, one for PARTS partitions.

    A task that is run again writes a file of another name, so none is ever half replaced.
    """

    def work(t: pa.Table) -> pa.Table:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        number = t["file"][0].as_py()
        name = f"{number}-{uuid.uuid4().hex[:12]}"
        before = np.zeros((PARTS, most + 1), "<i8")
        before[t["part"].to_numpy() % PARTS, t["length"].to_numpy()] = t["before"].to_numpy()
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(before.tobytes())
        return pa.table({"file": pa.array([number], pa.int64()), "name": pa.array([name])})

    found = each.withColumn("file", F.expr(f"part div {PARTS}")).groupBy("file").applyInArrow(work, "file bigint, name string")
    return {r.file: r.name for r in found.collect()}


def read_ranks(folder: str, files: dict[int, str], part: int, most: int) -> np.ndarray:
    """A partition's row of what ``write_ranks`` wrote, by its range."""
    system, root = fs.FileSystem.from_uri(folder)
    size = 8 * (most + 1)
    with system.open_input_file(f"{root}/{files[part // PARTS]}") as f:
        return np.frombuffer(f.read_at(size, size * (part % PARTS)), "<i8")


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, id_column: str = "doc_id", text: str = "text", end_id: int = 2, most: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Packs every document's tokens into sequences of at most ``most``; one row per piece with its sequence and offset.

    A null or empty text is the end token alone. Longer documents than ``most`` tokens are cut
    into full pieces after a first one that may be shorter. Very long texts are encoded a stretch at a time, whatever they are made of, and
    their pieces come in several batches. Repeated rows and equal or
    null ids give pieces of their own; ties of length are settled by a piece's place in its partition; an empty table gives no rows. Only the id and the
    text are read, so other columns can have any name. ``with_ids`` adds each piece's ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    with arrow_batches(spark):
        cut = scratch.save(pieces(docs, json_path, ranks_path, id_column, text, end_id, most, with_ids), "pieces")
    each = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    each = scratch.save(each.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")), "ranks")
    counts = np.zeros(most + 1, np.int64)
    for n, k in each.groupBy("length").agg(F.sum("n")).collect():  # at most ``most`` rows
        counts[n] = k
    made = runs(plan(counts, most))
    key = made["length"] * (1 << 44) + made["rank"]
    schema = cut.drop("part", "nth").schema.add("sequence_id", "long").add("offset", "long")

    folder = scratch.path("before")
    files = write_ranks(each, folder, most)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = -1, None
        for b in batches:
            if not b.num_rows:
                continue
            part, length, rank = b.column("part").to_numpy(), b.column("length").to_numpy(), b.column("nth").to_numpy().copy()
            # a file holds one partition's pieces, so rows of a partition stand together
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:]):
                if part[i] != now:
                    now, before = part[i], read_ranks(folder, files, int(part[i]), most)
                rank[i:j] += before[length[i:j]]
            run = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            where = [pa.array(made["sequence"][run] + rank - made["rank"][run]), pa.array(made["offset"][run])]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in schema.names[:-2]] + where, names=schema.names)

    with arrow_batches(spark):
        out = scratch.save(cut.mapInArrow(place, schema), "out")
    scratch.drop("pieces", "ranks", "before")
    return out.withColumnRenamed("__id", id_column)
