"""Near-duplicate documents by an LSH forest over word shingles, confirmed on full sets.

Each distinct shingle set has a MinHash signature. TREES orders sort all sets by a
stretch of the signature; sets that stand together with a long common prefix are candidates.
How long it must be depends on the region: DEPTH values at least, and more wherever a
region still holds over REGION sets, until it doesn't or the stretch is used up. A region that
is split also offers a link between its first set and the first of each part, so groups of
near copies of any size stay tied together, with a number of candidates in proportion to the rows. Regions
are found in range-sorted partitions, which cut a region anywhere.

Candidates are confirmed by intersecting full sets: first each set's least candidate, then all
others whose ends are still in different components. Every link that joins two components is exact.

What split or cut regions left out follows, as far as ends are still in different components: each set of such
a region is offered to the region's most linked set, then what remains is compared in blocks, on full sets, from which only the links
that join components come back. So the classes are those of all similar pairs that share DEPTH values in some tree, whatever the
size of a region and the number of partitions; such a pair of exactly 0.75 is missed with a probability of 0.0014.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayscape.llm.arrowio import slices, texts
from rayscape.llm.components import components, dealt_join, forest
from rayscape.llm.hashing import LOWER, U, batch_word_hashes, mix, window_hashes
from rayscape.llm.scratch import Scratch, arrow_batches, shuffle_width

SHINGLE = 5  # words
SIMILARITY = 75  # per cent
TREES = 12
STRIDE = 8  # signature values from one tree's stretch to the next one's
STRETCH = 16  # values in a tree's sort key
DEPTH = 3
REGION = 64
BLOCK = 1024  # sets of an open region that one task compares with as many others
BLOCK_SHINGLES = 500_000  # that they hold together
COMMON = 32  # sets of two blocks from which on a shingle they share is counted by a product of matrices
PART_ROWS = 250_000  # of all trees, in a range-sorted partition
VALUES = TREES * STRIDE
_rng = np.random.default_rng(75)
_ODD = _rng.integers(0, 2**63, VALUES, dtype=U) * U(2) + U(1)
_XOR = _rng.integers(0, 2**64, VALUES, dtype=U)


# -- shingles and signatures -------------------------------------------------------


def shingle_sets(parts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of k words, or of all words if there are fewer."""
    words, edges = batch_word_hashes([p.translate(LOWER) for p in parts])
    grams = window_hashes(words, k)
    out = []
    for i, j in zip(edges.tolist(), edges[1:].tolist()):
        n = j - i
        if n >= k:
            out.append(np.unique(grams[i : j - k + 1]))
        else:
            out.append(mix(window_hashes(words[i:j], n) ^ U(n)) if n else np.zeros(0, U))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES minima of the set under as many hashes, 16 bits of each."""
    with np.errstate(over="ignore"):
        least = np.full(VALUES, U(2**64 - 1))
        for at in range(0, len(s), 2048):
            part = s[at : at + 2048]
            for v in range(VALUES):
                least[v] = min(least[v], ((part ^ _XOR[v]) * _ODD[v]).min())
    return (mix(least) >> U(48)).astype(">u2")


def signed(rows: DataFrame) -> DataFrame:
    """(id, size of the set, fingerprint, signature) of each row."""
    kind = rows.schema["__id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            sets = shingle_sets(texts(b.column("__text")))
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            marks = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(marks, pa.binary())], ["__id", "n_shingles", "print", "mark"])

    return rows.mapInArrow(work, f"__id {kind}, n_shingles bigint, print binary, mark binary")


# -- forest ------------------------------------------------------------------------


def trees(sets: DataFrame) -> DataFrame:
    """A row for each set and tree: the tree's number and its stretch of the signature."""
    doubled = F.concat("mark", "mark")
    return sets.select("node", "n_shingles", F.posexplode(F.array(*(F.substring(doubled, 1 + 2 * STRIDE * t, 2 * STRETCH) for t in range(TREES)))).alias("tree", "key"))


def region_pairs(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, depth: int, out: list[np.ndarray]) -> None:
    """Candidates among sorted rows that share the first ``depth`` values."""
    todo = [(0, len(keys), depth)]
    while todo:
        i, j, d = todo.pop()
        if j - i < 2:
            continue
        if j - i > REGION and d < STRETCH:
            edges = [i, *(np.flatnonzero(keys[i + 1 : j, d] != keys[i : j - 1, d]) + i + 1).tolist(), j]
            firsts = np.array(edges[1:-1])
            if len(firsts):
                out.append(np.column_stack([np.full(len(firsts), nodes[i]), nodes[firsts]])[alike(sizes[i], sizes[firsts])])
            todo += [(a, b, d + 1) for a, b in zip(edges, edges[1:])]
        elif j - i > REGION:  # equal stretches: a chain of neighbours, and the first with each
            rest = np.arange(i + 1, j)
            some = [(rest - 1, rest), (np.full(len(rest), i), rest)]
            out += [np.column_stack([nodes[x], nodes[y]])[alike(sizes[x], sizes[y])] for x, y in some]
        else:
            x, y = np.triu_indices(j - i, 1)
            x, y = x + i, y + i
            ok = alike(sizes[x], sizes[y])
            out.append(np.column_stack([nodes[x[ok]], nodes[y[ok]]]))


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * np.minimum(x, y) >= SIMILARITY * np.maximum(x, y)


def candidates(sets: DataFrame, parts: int) -> DataFrame:
    """Candidate pairs (a > b) of nodes, some repeatedly, and the rows (a, tree, key, n_shingles) of regions whose pairs aren't all among them."""
    kind = sets.schema["node"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        keys = np.frombuffer(b"".join(t["key"].to_pylist()), ">u2").reshape(-1, STRETCH)
        tree, nodes, sizes = (t[c].to_numpy() for c in ("tree", "node", "n_shingles"))
        cut = (tree[1:] != tree[:-1]) | (keys[1:, :DEPTH] != keys[:-1, :DEPTH]).any(axis=1)
        edges = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(keys)]])
        out: list[np.ndarray] = []
        for i, j in zip(edges, edges[1:]):
            if j - i > 1:
                region_pairs(keys[i:j], nodes[i:j], sizes[i:j], DEPTH, out)
        pairs = np.concatenate(out) if out else np.zeros((0, 2), nodes.dtype)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        names = ["a", "b", "tree", "key", "n_shingles"]
        for k in range(0, len(pairs), 100_000):
            some = pairs[k : k + 100_000]
            blank = [pa.nulls(len(some), x) for x in (pa.int32(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(some[:, 1]), pa.array(some[:, 0]), *blank], names)
        for i, j in zip(edges, edges[1:]):
            if is_open(i, j, len(keys)):
                for b in t.slice(i, j - i).to_batches(100_000):
                    yield pa.RecordBatch.from_arrays([b["node"], pa.nulls(b.num_rows, b["node"].type), b["tree"].cast(pa.int32()), b["key"].cast(pa.binary()), b["n_shingles"].cast(pa.int64())], names)

    dealt = trees(sets).repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return dealt.mapInArrow(work, f"a {kind}, b {kind}, tree int, key binary, n_shingles bigint")


def is_open(i: int, j: int, n: int) -> bool:
    """Whether the rows i to j of a partition's n, which share DEPTH values, have pairs that weren't looked at: if they were split, or may go on in another partition."""
    return j - i > REGION or i == 0 or j == n


def regions(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of open regions with their component, and their region's weight and largest component, where a region has several.

    Weights count blocks: of BLOCK rows, or of BLOCK_SHINGLES shingles where that is less.
    """
    rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("prefix", F.substring("key", 1, 2 * DEPTH)).drop("key")
    weight = F.sum(F.greatest(F.lit(1 / BLOCK), F.col("n_shingles") / BLOCK_SHINGLES))
    groups = rows.groupBy("tree", "prefix", "component").agg(weight.alias("n"))
    several = groups.groupBy("tree", "prefix").agg(F.count("*").alias("groups"), F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("big")).filter("groups > 1")
    return dealt_join(rows, several.drop("groups"), ["tree", "prefix"])


def hub_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Each set of an open region with the region's most linked set, unless they are in one component."""
    degrees = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    hubs = rows.join(degrees, "node").groupBy("tree", "prefix").agg(F.max(F.struct("degree", "node", "component", "n_shingles")).alias("hub"))
    met = dealt_join(rows, hubs, ["tree", "prefix"]).filter(f"component <> hub.component and 100 * least(n_shingles, hub.n_shingles) >= {SIMILARITY} * greatest(n_shingles, hub.n_shingles)")
    return met.select(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b")).distinct()


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of x has in common with each of y, exactly."""
    out = np.zeros((len(x), len(y)), np.int64)
    if not len(x) or not len(y):
        return out
    values, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in [*x, *y]])
    n_left = sum(len(s) for s in x)
    left, right = (column[:n_left], owner[:n_left]), (column[n_left:], owner[n_left:] - len(x))
    in_left, in_right = np.bincount(left[0], minlength=len(values)), np.bincount(right[0], minlength=len(values))
    both = (in_left > 0) & (in_right > 0)
    common = both & (in_left + in_right > COMMON)
    # rare values: every pair of sets that holds one is listed
    rare = both & ~common
    a, b = rare[left[0]], rare[right[0]]
    order = np.argsort(right[0][b], kind="stable")
    held, holders = right[0][b][order], right[1][b][order]
    first, last = np.searchsorted(held, left[0][a], "left"), np.searchsorted(held, left[0][a], "right")
    times = last - first
    at = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    out += np.bincount(np.repeat(left[1][a], times) * len(y) + holders[at], minlength=out.size).reshape(out.shape)
    # common values: products of matrices of zeros and ones, some columns at a time
    number = np.cumsum(common) - 1
    for k in range(0, int(common.sum()), 1024):
        parts = []
        for (col, own), n in ((left, len(x)), (right, len(y))):
            some = common[col] & (number[col] >= k) & (number[col] < k + 1024)
            m = np.zeros((n, 1024), np.float32)
            m[own[some], number[col[some]] - k] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def block_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components of open regions, by comparing the full sets of their rows in blocks.

    Of a block's similar pairs, those come back that join its components. A region's largest component has blocks of its own, which are
    not compared with one another.
    """
    kind = rows.schema["node"].dataType.simpleString()
    rows = rows.withColumn("others", F.expr("bigint(ceil(total - big.n))")).withColumn("all", F.expr("others + bigint(ceil(big.n))"))
    rows = rows.withColumn("block", F.expr("if(component = big.component, others + pmod(xxhash64(node), all - others), pmod(xxhash64(node), others))"))
    rows = rows.select("tree", "prefix", "block", "others", "all", "node", "component").join(sets.hint("merge"), "node")
    rows = rows.withColumn("partner", F.explode(F.expr("sequence(0L, if(block < others, all, others) - 1L)")))
    dealt = rows.selectExpr("tree", "prefix", "least(block, partner) as lo", "greatest(block, partner) as hi", "block > partner as second", "node", "component", "shingles")

    def work(t: pa.Table) -> pa.Table:
        nodes, comps, second = (t[c].to_numpy() for c in ("node", "component", "second"))
        column = t["shingles"].combine_chunks()
        edges, values = column.offsets.to_numpy(), column.values.to_numpy()
        of = lambda at: [values[edges[k] : edges[k + 1]] for k in at.tolist()]
        size = np.diff(edges)
        one = t["lo"][0].as_py() == t["hi"][0].as_py()
        left, right = (np.arange(len(nodes)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
        wanted = (comps[left][:, None] != comps[right][None, :]) & alike(size[left][:, None], size[right][None, :])
        left, right, wanted = left[p := wanted.any(axis=1)], right[q := wanted.any(axis=0)], wanted[p][:, q]
        both = shared_counts(of(left), of(right))
        x, y = np.nonzero(wanted & (100 * both >= SIMILARITY * (size[left][:, None] + size[right][None, :] - both)))
        names, where = np.unique(comps, return_inverse=True)
        x, y = left[x], right[y]
        tree = forest(len(names), where[x], where[y])
        pairs = np.sort(np.column_stack([nodes[x[tree]], nodes[y[tree]]]), axis=1)
        return pa.table({"a": pairs[:, 1], "b": pairs[:, 0]})

    return dealt.groupBy("tree", "prefix", "lo", "hi").applyInArrow(work, f"a {kind}, b {kind}")


# -- confirmation --------------------------------------------------------------------


def full_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the documents that stand for the wanted nodes."""
    kind = rows.schema["__id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            sets = shingle_sets(texts(b.column("__text")))
            prints = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            edges = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = pa.array(np.concatenate(sets).view(np.int64)) if sets else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("__id"), prints, pa.ListArray.from_arrays(pa.array(edges), values)], ["node", "print", "shingles"])

    # what is wanted grows with the corpus, so it is never broadcast, however small it may be here
    found = rows.join(wanted.select(F.col("node").alias("__id")).hint("merge"), "__id", "left_semi")
    sets = found.select("__id", "__text").mapInArrow(work, f"node {kind}, print binary, shingles array<bigint>")
    return sets.join(wanted.hint("merge"), ["node", "print"], "left_semi").select("node", "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough, exactly."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("both"))
    return shared.filter(f"100 * both >= {SIMILARITY} * (p + q - both)").select("a", "b")


def cluster(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept`` (id = component).

    A-Z count as lower case; words are ``[^\\x20\\x09-\\x0D]+``, of whole texts however long. Rows with equal sets are linked whatever their ids;
    null, empty and wordless texts are linked with nothing. Rows with a null id keep a null component and are
    kept; they tie nothing together. Rows that share an id share its links. An empty table gives no rows. Only the id
    and the text are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = docs.select(docs[id_column].alias("__id"), docs[text].alias("__text"))
    with arrow_batches(spark):
        marks = scratch.save(signed(rows), "marks")
        usable = marks.filter("n_shingles > 0 and __id is not null")
        sets = scratch.save(usable.groupBy("print").agg(F.min("__id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("mark").alias("mark")), "sets")
        parts = max(2 * shuffle_width(spark), -(-sets.count() * TREES // PART_ROWS))
        found = scratch.save(candidates(sets, parts), "found")
        pairs = scratch.save(found.filter("tree is null").select("a", "b").distinct(), "pairs")
        left = found.filter("tree is not null").select(F.col("a").alias("node"), "tree", "key", "n_shingles")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(left.select("node")).distinct()
        wanted = sets.join(ends, "node").select("node", "print")
        full = scratch.save(full_sets(rows, wanted), "full")
        least = pairs.groupBy("a").agg(F.min("b").alias("b"))
        links = scratch.save(confirmed(least, full), "links")
        labels = scratch.save(components(links, scratch, "first"), "labels")
        rest = (
            pairs.join(least, ["a", "b"], "left_anti")
            .join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            .filter("coalesce(ca, a) <> coalesce(cb, b)")
            .select("a", "b")
        )
        near = links.unionByName(scratch.save(confirmed(rest, full), "more"))
        if not left.isEmpty():
            labels = scratch.save(components(near, scratch, "second"), "labels-2")
            hubs = hub_pairs(scratch.save(regions(left, labels), "open-1"), near)
            near = near.unionByName(scratch.save(confirmed(hubs, full), "hubs"))
            labels = scratch.save(components(near, scratch, "third"), "labels-3")
            near = near.unionByName(scratch.save(block_links(scratch.save(regions(left, labels), "open-2"), full), "others"))
        same = usable.groupBy("__id").agg(F.min("print").alias("p"), F.max("print").alias("q")).filter("p <> q").select("__id")  # ids with several texts
        tie = usable.join(same, "__id", "left_semi").select(F.col("__id").alias("a"), "print").join(sets.select("print", F.col("node").alias("b")), "print").select("a", "b")
        labels = scratch.save(components(near.unionByName(tie), scratch, "last"), "components")
        linked = (
            marks.join(sets.select("print", "node"), "print", "left")
            .join(labels, "node", "left")
            .select(F.col("__id"), "n_shingles", F.when(F.col("__id").isNotNull(), F.coalesce("component", "node", "__id")).alias("component_id"))
        )
        out = scratch.save(linked.withColumn("kept", F.col("__id").eqNullSafe(F.col("component_id"))), "out")
    scratch.drop("marks", "sets", "found", "pairs", "full", "links", "labels", "more", "labels-2", "open-1", "hubs", "labels-3", "open-2", "others", "components")
    return out.withColumnRenamed("__id", id_column)
