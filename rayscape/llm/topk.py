"""Exact top-k search by inner product over paged M-trees, best first.

Integer vectors x of norms up to M are raised by one component, sqrt(M**2 - |x|**2);
for a query q (raised by zero) the Euclidean distance then falls as the inner product
grows, so a metric index finds the largest products exactly. Pivots, whose number grows with the rows up to a
bound, cut the rows into cells by place; cells that hold more than a page are cut into rings about their pivot, and
rings of equal distance by salt. Each page is an M-tree: routing objects with covering radii and distances to their parents, leaves with
their entries' distances to the routing object. A search takes the node of the least
possible distance first and leaves out, by stored distances alone, what the triangle inequality excludes.

Queries first search the page they live in, which gives each a bound to begin with;
then blocks of queries travel to the pages of those cells that the bound leaves open. A page's tree is read once by a task,
which streams the blocks through it. How much is left out depends on the vectors: nothing to speak of where they are
spread evenly over many dimensions, as no metric index can there.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayscape.llm.arrowio import sorted_runs
from rayscape.llm.scratch import Scratch, arrow_batches, shuffle_width
from rayscape.llm.vectors import matrix, usable

PIVOTS = 16_384  # at the most; they go to every task
PAGE = 2048  # rows that pivots and rings aim at
RINGS = 64  # of a cell at the most, before salt
LEAF = 192  # rows
FAN = 8
QUERY_BLOCK = 256
SHARE = 64  # blocks of queries that one task takes through a page
SCALE = 256
EXACT = 2.0**52  # sums of products up to this are exact as doubles


class Tree:
    """An M-tree over the rows of one page."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, top: float):
        self.x, self.rows, self.ids, self.top = x, rows, ids, top
        self.norm2 = np.einsum("ij,ij->i", x, x)
        self.lift = np.sqrt(np.maximum(0, top - self.norm2))
        self.route: list[int] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.below: list[np.ndarray] = []  # nodes, or rows of a leaf
        self.leaf: list[bool] = []
        self.entry = np.zeros(len(x))
        self.ring = 0.0, math.inf  # least and greatest distance from the cell's pivot
        self.scored = 0  # rows whose product a search has computed
        self.roots = np.array([self._grow(np.arange(len(x)), -1)])

    def dist(self, a: np.ndarray, b: int) -> np.ndarray:
        return np.sqrt(((self.x[a] - self.x[b]) ** 2).sum(axis=1) + (self.lift[a] - self.lift[b]) ** 2)

    def _grow(self, members: np.ndarray, parent: int) -> int:
        middle = self.x[members].mean(axis=0)
        route = int(members[np.argmin(((self.x[members] - middle) ** 2).sum(axis=1))])
        far = self.dist(members, route)
        me = len(self.route)
        self.route.append(route)
        self.radius.append(float(far.max()))
        self.to_parent.append(float(self.dist(np.array([route]), parent)[0]) if parent >= 0 else 0.0)
        self.below.append(members)
        self.leaf.append(len(members) <= LEAF)
        if self.leaf[me]:
            self.entry[members] = far
            return me
        seeds, near = [], far
        for _ in range(FAN):
            seeds.append(int(members[np.argmax(near)]))
            near = np.minimum(near, self.dist(members, seeds[-1]))
        part = np.argmin(np.column_stack([self.dist(members, s) for s in seeds]), axis=1)
        if (part == part[0]).all():  # equal rows
            part = np.arange(len(members)) * FAN // len(members)
        self.below[me] = np.array([self._grow(members[part == p], route) for p in np.unique(part)])
        return me

    def search(self, q: np.ndarray, k: int, floor: float, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of the best k whose scores reach ``floor``; ties go to smaller ids. The row ``skip`` is no candidate."""
        qq = float(q @ q)
        both = qq + self.top
        slack = 0.01 + 1e-9 * both
        most = lambda d: (both - d * d) / 2 + slack
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        bound = floor
        heap = [(0.0, int(r), float(math.sqrt(max(0.0, both - 2 * (self.x[self.route[r]] @ q))))) for r in self.roots]
        while heap:
            low, node, dq = heapq.heappop(heap)
            if most(low) < bound:
                break
            below = self.below[node]
            if self.leaf[node]:
                ok = most(np.abs(dq - self.entry[below])) >= bound
                rows = below[ok]
                rows = rows[self.rows[rows] != skip]
                s = self.x[rows] @ q
                self.scored += len(rows)
                good = s >= bound
                best_s, best_i = np.concatenate([best_s, s[good]]), np.concatenate([best_i, rows[good]])
                if len(best_s) > k:
                    keep = np.lexsort((self.ids[best_i], -best_s))[:k]
                    best_s, best_i = best_s[keep], best_i[keep]
                if len(best_s) == k:
                    bound = max(bound, best_s.min())
                continue
            radius, away = np.array([self.radius[c] for c in below]), np.array([self.to_parent[c] for c in below])
            maybe = below[most(np.maximum(0, np.abs(dq - away) - radius)) >= bound]
            if len(maybe):
                routes = np.array([self.route[c] for c in maybe])
                d = np.sqrt(np.maximum(0, both - 2 * (self.x[routes] @ q)))
                for c, dc in zip(maybe.tolist(), d.tolist()):
                    low = max(0.0, dc - self.radius[c])
                    if most(low) >= bound:
                        heapq.heappush(heap, (low, c, dc))
        order = np.lexsort((self.ids[best_i], -best_s))
        return best_s[order], best_i[order]


def integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) in whole numbers, as doubles."""
    return np.floor(matrix(column) * SCALE)


def whole_numbers(column: pa.Array) -> np.ndarray:
    """The same as Python's integers, of any size."""
    exact = lambda x: int(x) * SCALE if abs(x) >= 2.0**60 else math.floor(x * SCALE)
    return np.array([[exact(x) for x in row] for row in column.to_pylist()], object)


class Pivots:
    """Two levels of pivots: every one belongs to the nearest of the first ones."""

    def __init__(self, x: np.ndarray, top: float):
        self.x, self.top = x, top
        self.norm2 = (x**2).sum(axis=1)
        self.lift = np.sqrt(np.maximum(0, top - self.norm2))
        n = math.ceil(math.sqrt(len(x)))
        first = self.distances2(x, self.norm2, np.arange(n)).argmin(axis=1) if len(x) else np.zeros(0, int)
        first[:n] = np.arange(n)
        self.groups = [np.flatnonzero(first == g) for g in range(n)]

    def distances2(self, x: np.ndarray, norm2: np.ndarray, which: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0, self.top - norm2))
        return norm2[:, None] + self.norm2[which] - 2 * x @ self.x[which].T + (lift[:, None] - self.lift[which]) ** 2

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance) of each row: the nearest of those that belong to the nearest first one."""
        norm2 = (x**2).sum(axis=1)
        group = self.distances2(x, norm2, np.arange(len(self.groups))).argmin(axis=1)
        cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            d2 = self.distances2(x[rows], norm2[rows], self.groups[g])
            best = d2.argmin(axis=1)
            cell[rows], far[rows] = self.groups[g][best], np.sqrt(np.maximum(0, d2[np.arange(len(rows)), best]))
        return cell, far


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Each query's k rows of the largest integer inner products: ``query_id, rank`` (from 1)``, vec_id, score``.

    Components count as floor(256 * x). Queries are the rows where ``is_query`` holds; candidates are all rows but the query's own
    one. Ties go to smaller ids. Fewer than k candidates are all returned. Vectors that are
    null, empty or hold null or non-finite components take no part, nor do rows with a null
    id. Rows that share an id count as rows of their own. Vectors are compared with those of their own size, one size after another. Vectors of
    components so large that doubles would not hold their scores are compared with all others in Python's integers; a score beyond a long is
    given, and ranked, as the nearest long. An empty table, or one row, gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    kind = vectors.schema[id_column].dataType.simpleString()
    rows = vectors.filter(usable(F.col(column)) & F.col(id_column).isNotNull())
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))) * SCALE + 1
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "size": F.size("v"), "wide": largest * largest * F.size("v") > EXACT})
    rows = scratch.save(rows, "rows")
    found = []
    for size, n_wide in rows.groupBy("size").agg(F.count_if("wide")).collect():  # one row a size of vectors
        own = rows.filter(F.col("size") == size)
        plain = own.filter("not wide") if n_wide else own
        found.append(tree_search(plain, k, scratch, f"{size}"))
        if n_wide:
            found.append(scan(own.filter("wide and query"), own, k, scratch, f"{size}-wide"))
            found.append(scan(plain.filter("query"), own.filter("wide"), k, scratch, f"{size}-plain"))
    best = spark.createDataFrame([], FOUND)
    for part in found:
        best = best.unionByName(part)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = scratch.save(best.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score"), "out")
    scratch.drop("rows", *scratch.made("cells", "trees", "far", "scan"))
    return out


FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint"


def tree_search(rows: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """Candidates (row, query_id, vec_id, score) for each query's best k among rows of one size, by the trees."""
    spark = rows.sparkSession
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE))
    n, top = rows.agg(F.count("*"), F.max(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    if not n:
        return spark.createDataFrame([], FOUND)
    wanted = max(1, min(PIVOTS, n // PAGE))
    picked = [r[0] for r in rows.select("v", F.xxhash64("row").alias("h"), "row").orderBy("h", "row").limit(wanted).select("v").collect()]
    pivots = Pivots(integers(pa.array(picked)), float(top))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, far = pivots.nearest(integers(b.column("v")))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("row", "id", "query", "v")] + [pa.array(cell.astype(np.int32)), pa.array(far)], ["row", "id", "query", "v", "cell", "far"])

    with arrow_batches(spark):
        dealt = scratch.save(rows.select("row", "id", "query", "v").mapInArrow(cells, f"row bigint, id bigint, query boolean, v {rows.schema['v'].dataType.simpleString()}, cell int, far double"), f"cells-{name}")
    # a cell over a page is cut at every RINGS / rings-th of these distances; a row on several cuts at once goes to any ring between them
    cuts = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 10_000).alias("cuts"))
    cuts = cuts.withColumn("rings", F.expr(f"int(least({RINGS}, pow(2, ceil(log2(greatest(1, n / {PAGE}))))))"))
    cuts = cuts.select("cell", "radius", F.expr(f"filter(cuts, (c, i) -> (i + 1) % ({RINGS} div rings) = 0)").alias("cuts"), F.expr(f"int(ceil(n / ({PAGE} * rings)))").alias("salts"))
    cuts = scratch.save(cuts, f"cells-{name}-cuts")
    low, high = F.expr("size(filter(cuts, c -> c < far))"), F.expr("size(filter(cuts, c -> c <= far))")
    paged = dealt.join(cuts, "cell").withColumns({"low": low, "high": high})
    paged = paged.withColumn("page", F.expr("int((low + pmod(xxhash64(row, 3), high - low + 1)) * salts + pmod(xxhash64(row, 5), salts))")).select("cell", "page", "row", "id", "query", "v", "far")
    radius = np.full(len(pivots.x), -1.0)
    for r in cuts.select("cell", "radius").collect():  # PIVOTS rows at most
        radius[r.cell] = r.radius

    def grow(t: pa.Table) -> Iterator[pa.RecordBatch]:
        x, row, ids, is_q, far = integers(t["v"]), t["row"].to_numpy(), t["id"].to_numpy(), t["query"].to_numpy(), t["far"].to_numpy()
        tree = Tree(x, row, ids, float(top))
        tree.ring = float(far.min()), float(far.max())
        where = (t["cell"][0].as_py(), t["page"][0].as_py())
        out = [(*where, pickle.dumps(tree), *[None] * 6)]
        for i in np.flatnonzero(is_q):
            s, found = tree.search(x[i], k, -math.inf, row[i])
            floor = float(s[-1]) if len(s) == k else -math.inf
            out.append((*where, None, int(row[i]), int(ids[i]), x[i].astype(np.float64).tobytes(), floor, ids[found].astype(np.int64).tolist(), s.astype(np.int64).tolist()))
        for r in range(0, len(out), 64):
            cols = list(zip(*out[r : r + 64]))
            types = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, types)], ["cell", "page", "tree", "row", "id", "q", "floor", "found", "scores"])

    width = shuffle_width(spark)
    schema = "cell int, page int, tree binary, row bigint, id bigint, q binary, floor double, found array<bigint>, scores array<bigint>"
    with arrow_batches(spark):
        grown = scratch.save(sorted_runs(paged, max(2 * width, -(-n // (16 * PAGE))), ["cell", "page"], grow, schema), f"trees-{name}")
    asked = grown.filter("tree is null")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shares = -(-n_blocks // SHARE)

    def routes(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """For each cell, those queries of a block that it may hold better rows for."""
        q = np.stack([np.frombuffer(x, np.float64) for x in t["q"].to_pylist()])
        floor, share = t["floor"].to_numpy(), t["block"][0].as_py() % shares
        both = (q**2).sum(axis=1) + top
        d = np.sqrt(np.maximum(0, both[:, None] - 2 * q @ pivots.x.T))
        may = reaches(np.maximum(0, d - radius), both[:, None], floor[:, None]) & (radius >= 0)
        about = {c: t[c].to_numpy() for c in ("row", "id", "cell", "page")}
        for cell in np.flatnonzero(may.any(axis=0)):
            some = np.flatnonzero(may[:, cell])
            packed = pickle.dumps(({c: v[some] for c, v in about.items()}, floor[some], d[some, cell], q[some].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([int(cell)], pa.int32()), pa.array([share], pa.int64()), pa.array([packed], pa.binary())], ["cell", "share", "body"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for b in batches:
            for cell, page, share, kind, body in zip(*(b.column(c).to_pylist() for c in ("cell", "page", "share", "kind", "body"))):
                if kind == 0:
                    now, tree = (cell, page, share), pickle.loads(body)
                    continue
                assert now == (cell, page, share)
                about, floor, away, q = pickle.loads(body)
                both = (q.astype(np.float64) ** 2).sum(axis=1) + top
                gap = np.maximum(0, np.maximum(tree.ring[0] - away, away - tree.ring[1]))
                home = (about["cell"] == cell) & (about["page"] == page)
                out = []
                for i in np.flatnonzero(~home & reaches(gap, both, floor)):
                    s, found = tree.search(q[i].astype(np.float64), k, floor[i], about["row"][i])
                    out += [(about["row"][i], about["id"][i], j, v) for j, v in zip(tree.ids[found].tolist(), s.astype(np.int64).tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "query_id", "vec_id", "score"])

    with arrow_batches(spark, 4):
        calls = sorted_runs(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks))).select("block", "cell", "page", "row", "id", "q", "floor"), max(width, n_blocks // 16), ["block"], routes, "cell int, share bigint, body binary")
        trees = grown.filter("tree is not null").select("cell", "page", "tree")
        calls = calls.join(trees.select("cell", "page"), "cell").selectExpr("cell", "page", "share", "1 as kind", "body")
        each = trees.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))).selectExpr("cell", "page", "share", "0 as kind", "tree as body")
        spread = each.unionByName(calls).repartition(max(4 * width, -(-n // (4 * PAGE))), "cell", "page", "share").sortWithinPartitions("cell", "page", "share", "kind")
        far = scratch.save(spread.mapInArrow(visit, FOUND), f"far-{name}")
    own = asked.select("row", F.col("id").alias("query_id"), F.explode(F.arrays_zip("found", "scores")).alias("x")).select("row", "query_id", F.col("x.found").alias("vec_id"), F.col("x.scores").alias("score"))
    return own.unionByName(far)


def reaches(distance: np.ndarray, both: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether a point at this distance or beyond can score ``floor``; ``both`` is the sum of the squared norms."""
    return (both - distance**2) / 2 + 0.01 + 1e-9 * both >= floor


def scan(queries: DataFrame, rows: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """The same without an index, in integers of any size: blocks of queries against blocks of rows. Only for components that doubles can't square."""
    width, parts, asked = shuffle_width(rows.sparkSession), -(-rows.count() // PAGE), -(-queries.count() // QUERY_BLOCK)
    if not parts or not asked:
        return rows.sparkSession.createDataFrame([], FOUND)

    def pack(t: pa.Table) -> Iterator[pa.RecordBatch]:
        body = pickle.dumps((t["row"].to_numpy(), t["id"].to_numpy(), whole_numbers(t["v"])))
        yield pa.RecordBatch.from_arrays([t["part"].combine_chunks()[:1], pa.array([body], pa.binary())], ["part", "body"])

    def packed(df: DataFrame, n: int) -> DataFrame:
        return sorted_runs(df.select(F.pmod(F.xxhash64("row"), F.lit(n)).alias("part"), "row", "id", "v"), min(n, 4 * width), ["part"], pack, "part bigint, body binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, every in zip(b.column("asked").to_pylist(), b.column("body").to_pylist()):
                (q_row, q_id, q), (row, ids, x) = pickle.loads(some), pickle.loads(every)
                out = []
                for i in range(len(q)):
                    score = [(-max(-(2**63), min(2**63 - 1, v)), j) for v, j, r in zip((x @ q[i]).tolist(), ids.tolist(), row.tolist()) if r != q_row[i]]
                    out += [(q_row[i], q_id[i], j, -v) for v, j in heapq.nsmallest(k, score)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [()] * 4)], ["row", "query_id", "vec_id", "score"])

    with arrow_batches(rows.sparkSession, 1):
        blocks = packed(queries, asked).select(F.col("body").alias("asked"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
        return scratch.save(packed(rows, parts).join(blocks, "part").repartition(4 * width).mapInArrow(compare, FOUND), f"scan-{name}")
