"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random into CODE dimensions and kept as its signs, with
the inner product of vector and code as correction factor. For another unit vector q,
<code, q> / <code, vector> estimates <vector, q> without bias, with an error whose
spread the factor gives as well. Pairs whose upper confidence bound stays below the
threshold are passed over; all others are computed exactly, in double precision.

Codes and factors are stored; the other side of an estimate is the vector itself at eight bits a component, whose error is
stored as well and widens the bound.

Which pairs meet is settled by tables that key vectors by the first signs of further
rotations; their number follows from the key's length and the wanted recall. A bucket is
compared in blocks of BLOCK vectors, so that one with a third of all rows is many tasks. Only codes travel to all tables; full vectors follow
to those blocks where a bound leaves a pair of theirs open. A pair is
counted in the first table where its keys agree. Blocks give each vector a
count and a forest of links, never a list of all pairs. Equal vectors are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayscape.llm.arrowio import sorted_runs
from rayscape.llm.components import components, forest
from rayscape.llm.scratch import Scratch, arrow_batches, shuffle_width
from rayscape.llm.vectors import by_size, matrix, units, usable

THRESHOLD = 0.95
CODE = 256  # bits
SIGMAS = 5.0  # of the confidence bound
RECALL = 0.999  # of pairs just at the threshold
BUCKET = 48  # vectors per bucket that the key's length aims at
BLOCK = 512
SEED = 20240521


def rotation(n: int, dims: int, seed: int) -> np.ndarray:
    """n orthonormal rows if n <= dims, else that many columns of an orthonormal frame of n dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((max(n, dims), max(n, dims))))
    return (q * np.sign(np.diag(r)))[:n, :dims]


def layout(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, number of tables) for n vectors."""
    bits = max(4, min(30, math.ceil(math.log2(max(2, n / BUCKET)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def keys(unit: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Integer keys of each vector, one per table."""
    planes = np.random.default_rng(seed).standard_normal((unit.shape[1], bits * tables))
    signs = (unit @ planes > 0).reshape(len(unit), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(axis=2).astype(np.int32)


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, their signs as -1 and 1, correction factors)."""
    turned = (unit @ turn.T).astype(np.float32)
    signs = np.where(turned > 0, np.float32(1), np.float32(-1))
    return turned, signs, np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[0])


def eight_bits(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components in steps, size of a step, length of the error) of each vector."""
    step = np.abs(unit).max(axis=1) / 127
    low = np.rint(unit / step[:, None]).astype(np.int8)
    return low, step, np.linalg.norm(unit - low * step[:, None], axis=1)


def may_link(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, threshold: float, error: np.ndarray | float = 0.0) -> np.ndarray:
    """For each code and query vector, whether the upper bound of the inner product reaches the threshold; ``error`` is that of the query vectors."""
    size = signs.shape[1]
    estimate = (signs @ turned.T) / math.sqrt(size) / factor[:, None]
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(size - 1)
    return estimate + SIGMAS * spread[:, None] + error / factor[:, None] >= threshold


def link(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: its id, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable) and ``kept``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing. All
    others are compared with those of their own size, whatever their length. Equal vectors link with one another. Rows that share an id count as rows of their own, and
    a null id keeps a null component, is kept and gives no component its name. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddup")
    rows = vectors.select(vectors[id_column].alias("__id"), vectors[column].alias("__v"))
    good = usable(F.col("__v")) & F.exists("__v", lambda x: x != 0)
    every = scratch.save(rows.withColumn("good", good).withColumn("print", F.when(F.col("good"), F.sha2(F.to_json(F.struct("__v")), 256))), "every")
    valid = every.filter("good")
    sets = valid.groupBy("print").agg(F.min("__id").alias("low"), F.count("*").alias("copies"), F.first("__v").alias("v"))
    sets = scratch.save(sets.withColumn("node", F.xxhash64("print")), "sets")
    bits, tables = layout(sets.count(), threshold)
    turns: dict[int, np.ndarray] = {}

    def turn(dims: int) -> np.ndarray:
        if dims not in turns:
            turns[dims] = rotation(max(CODE, dims), dims, SEED)
        return turns[dims]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, v in by_size(b.column("v")):
                unit = units(v)
                _, signs, factor = codes(unit, turn(v.shape[1]))
                low, step, error = eight_bits(unit)
                k = keys(unit, bits, tables)
                some = b.take(pa.array(at))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * tables), pa.array(k.ravel()))
                packed = [[x.tobytes() for x in y] for y in (np.packbits(signs > 0, axis=1), low)]
                arrays = [some.column("node"), some.column("copies"), some.column("v"), pa.array(np.full(len(v), v.shape[1], np.int32)), flat, *(pa.array(x, pa.binary()) for x in packed), *(pa.array(np.asarray(x, np.float64)) for x in (factor, step, error))]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "copies", "v", "dims", "keys", "code", "low", "factor", "step", "error"])

    table = f"node bigint, copies bigint, v {sets.schema['v'].dataType.simpleString()}, dims int, keys array<int>, code binary, low binary, factor double, step double, error double"
    with arrow_batches(spark):
        known = scratch.save(sets.select("node", "copies", "v").mapInArrow(keyed, table), "keyed")
    place = ["dims", "t", "bucket"]
    dealt = known.select("node", "dims", F.posexplode("keys").alias("t", "bucket"))
    full = dealt.groupBy(*place).agg(F.count("*").alias("size")).filter("size > 1")
    full = full.withColumn("chunks", F.expr(f"int((size + {BLOCK - 1}) div {BLOCK})"))
    coded = known.select("node", "dims", "code", "low", "factor", "step", "error", F.posexplode("keys").alias("t", "bucket"), "keys").withColumn("before", F.expr("slice(keys, 1, t)")).drop("keys")
    placed = coded.join(full, place).withColumn("chunk", F.expr("int(pmod(xxhash64(node, 7), chunks))")).drop("size")
    # chunk c stands on the left of blocks (c, c..) and on the right of blocks (..c, c)
    spots = placed.withColumn("spot", F.explode(F.expr("transform(sequence(0, chunks - 1), o -> named_struct('i', least(chunk, o), 'j', greatest(chunk, o)))")))
    block = [*place, "i", "j"]
    spots = spots.select(*place, "spot.i", "spot.j", "chunk", "node", "code", "low", "factor", "step", "error", "before")

    def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        left = np.flatnonzero(t["chunk"].to_numpy() == i)
        return left, left if i == j else np.flatnonzero(t["chunk"].to_numpy() == j), i == j

    def seen(before: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs have met in an earlier table."""
        return (before[x] == before[y]).any(axis=1)

    def bounded(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Nodes of a block that are in a pair whose bound leaves it open, and that meets for the first time."""
        dims = t["dims"][0].as_py()
        signs = np.unpackbits(np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1), axis=1)[:, : max(CODE, dims)].astype(np.float32) * 2 - 1
        rough = np.frombuffer(b"".join(t["low"].to_pylist()), np.int8).reshape(t.num_rows, dims) * t["step"].to_numpy()[:, None]
        turned = (rough @ turn(dims).T).astype(np.float32)
        factor, error = t["factor"].to_numpy(), t["error"].to_numpy() + 1e-5
        before = matrix(t["before"]).astype(np.int32)
        left, right, one = sides(t)
        hit = np.zeros(t.num_rows, bool)
        for a in range(0, len(left), BLOCK):
            part = left[a : a + BLOCK]
            x, y = np.nonzero(may_link(signs[part], factor[part], turned[right], threshold, error[right]))
            x, y = part[x], right[y]
            if one:
                x, y = x[x < y], y[x < y]
            for c in range(0, len(x), 1 << 16):
                p, q = x[c : c + (1 << 16)], y[c : c + (1 << 16)]
                new = ~seen(before, p, q)
                hit[p[new]] = hit[q[new]] = True
        if hit.any():
            some = t.select([*block, "chunk", "node"]).take(pa.array(np.flatnonzero(hit))).combine_chunks()
            yield from some.to_batches()

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        now = t["t"][0].as_py()
        v, node, copies = matrix(t["v"]), t["node"].to_numpy(), t["copies"].to_numpy()
        before = matrix(t["keys"]).astype(np.int32)[:, :now]
        v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
        size = np.linalg.norm(v, axis=1)
        left, right, one = sides(t)
        counts = np.zeros(len(v), np.int64)
        xs, ys = [], []
        for a in range(0, len(left), 64):
            part = left[a : a + 64]
            x, y = np.nonzero((v[part] @ v[right].T) / (size[part][:, None] * size[right]) >= threshold - 1e-9)
            p, q = part[x], right[y]
            if one:
                p, q = p[p < q], q[p < q]
            near = np.einsum("ij,ij->i", v[p], v[q]) / (size[p] * size[q]) >= threshold
            near &= ~seen(before, p, q)
            xs.append(p[near])
            ys.append(q[near])
        x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (xs, ys))
        np.add.at(counts, x, copies[y])
        np.add.at(counts, y, copies[x])
        tree = forest(len(v), x, y)
        some = np.flatnonzero(counts)
        a = np.concatenate([node[x[tree]], node[some]]) if len(some) else node[:0]
        b = np.concatenate([node[y[tree]], np.full(len(some), 0)]) if len(some) else node[:0]
        k = np.concatenate([np.full(len(tree), -1), counts[some]]) if len(some) else counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(k.astype(np.int64))], ["a", "b", "links"])

    width = 2 * shuffle_width(spark)
    with arrow_batches(spark):
        left = scratch.save(sorted_runs(spots, width, block, bounded, "dims int, t int, bucket int, i int, j int, chunk int, node bigint"), "open")
        left = left.join(known.select("node", "copies", "v", "keys").hint("merge"), "node")
        found = scratch.save(sorted_runs(left, width, block, compare, "a bigint, b bigint, links bigint"), "found")
    counts = found.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(found.filter("links = -1").select("a", "b"), scratch)
    sets = sets.join(groups, "node", "left").join(counts, "node", "left").select("print", "low", "copies", "links", F.coalesce("component", "node").alias("component"))
    names = sets.groupBy("component").agg(F.min("low").alias("name"))
    known = sets.join(names, "component").select("print", F.col("name"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = every.join(known, "print", "left").select(
        F.col("__id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("__id").isNotNull(), F.coalesce("name", "__id")).alias("component_id"),
    )
    out = scratch.save(out.withColumn("kept", F.col("__id").eqNullSafe(F.col("component_id"))), "out")
    scratch.drop("every", "sets", "keyed", "open", "found")
    return out.withColumnRenamed("__id", id_column)
