"""Exact top-k inner products by a dual-tree cover-tree search.

Vectors are cut into integer components, dealt to the nearest of a few
centers (the top level of the cover tree, chosen farthest-first on a bounded
sample) and on to blocks of bounded size. Inside a task a block's cover tree
and the cover tree of the queries that came to it are walked together: a pair
of nodes is dropped when no vector below one can score with a query below the
other as much as the query group's worst k-th score so far. The bound comes
from the nodes' centers, norms and covering radii.

Round one: every query against the block it lies in, which gives it k scores
to beat. Round two: every query goes only to the blocks whose center and
covering radius leave room for a better or equal score. Both rounds are exact
and their results are merged; no block or list of partners is cut short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Rows that the centers are chosen on; rows for each center; most centers.
SAMPLE_ROWS = 4096
ROWS_PER_CENTER = 8192
MAX_CENTERS = 512
#: Vectors of a block, queries that meet it in one task, queries of one tree.
BLOCK = 4096
QUERY_GROUP = 65_536
QUERY_TREE = 1024
#: Points of a leaf, least mean points of a node's children, points scored at once.
LEAF = 128
POINTS_PER_CHILD = 16
POINTS = 1024
MAX_DIMENSIONS = 50


# --- cover tree -------------------------------------------------------------

class CoverTree:
    """Nodes over a permutation of the points: ``center`` (a point),
    ``radius`` (to the farthest point below), ``lo``/``hi`` (points below) and
    ``children``. Children of a node of radius s are centers more than s/2
    apart that cover its points within s/2. A node stays a leaf when it is
    small, or when its points have no such structure (the children would be
    almost as many as the points)."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.center: list[int] = []
        self.radius: list[float] = []
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.children: list[np.ndarray] = []
        self.order: list[np.ndarray] = []
        self._filled = 0
        if len(points):
            self._grow(np.arange(len(points)), int(np.einsum("ij,ij->i", points, points).argmin()))
        self.perm = np.concatenate(self.order) if self.order else np.empty(0, np.int64)
        norms = np.sqrt(np.einsum("ij,ij->i", points, points))
        self.norm = norms[self.center] if len(points) else norms
        self.leaf = np.array([not len(c) for c in self.children], bool)
        self.rad = np.array(self.radius)

    def _distances(self, center: int, at: np.ndarray) -> np.ndarray:
        d = self.points[at] - self.points[center]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _covers(self, at: np.ndarray, center: int, cover: float) -> list[tuple[np.ndarray, int]]:
        """Points and center of each child; none if there would be too many."""
        out, left, c = [], at, center
        while len(left):
            near = self._distances(c, left) <= cover
            near |= left == c
            out.append((left[near], c))
            if len(out) * POINTS_PER_CHILD > len(at):
                return []
            left = left[~near]
            c = int(left[0]) if len(left) else -1
        return out

    def _grow(self, at: np.ndarray, center: int) -> int:
        me = len(self.center)
        radius = float(self._distances(center, at).max())
        self.center.append(center)
        self.radius.append(radius)
        self.lo.append(self._filled)
        self.hi.append(self._filled + len(at))
        self.children.append(np.empty(0, np.int64))
        parts = self._covers(at, center, radius / 2) if len(at) > LEAF and radius > 0 else []
        if not parts:
            self.order.append(at)
            self._filled += len(at)
        else:
            self.children[me] = np.array([self._grow(p, c) for p, c in parts])
        return me

    def rows(self, node: int) -> np.ndarray:
        return self.perm[self.lo[node]: self.hi[node]]


class _Best:
    """The k best (score, smaller id) of each query."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of these queries with some candidates."""
        k = self.k
        least = self.worst(rows)
        if score.shape[1] > k:
            least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
        r, c = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        if not len(r):
            return
        hit = np.unique(r)
        old = np.repeat(hit, k)
        r_all = np.concatenate([old, r])
        s_all = np.concatenate([self.score[rows[hit]].ravel(), score[r, c]])
        i_all = np.concatenate([self.id[rows[hit]].ravel(), ids[c]])
        order = np.lexsort((i_all, -s_all, r_all))
        r_all = r_all[order]
        place = np.arange(len(r_all)) - np.searchsorted(r_all, r_all)
        keep = place < k
        at = order[keep]
        self.score[rows[r_all[keep]], place[keep]] = s_all[at]
        self.id[rows[r_all[keep]], place[keep]] = i_all[at]


def dual_search(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, d: np.ndarray, d_id: np.ndarray,
                data: CoverTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), each (queries, k), best first; -inf where there are
    fewer. Scores below ``floor`` may be left out. Inner products of integer
    components are exact as far as doubles are (2**53)."""
    best = _Best(len(q), k, floor)
    if not len(q) or not len(d):
        return best.score, best.id
    tree = CoverTree(q)
    dot = q[tree.center] @ d[data.center].T
    rq, rd = tree.rad[:, None], data.rad
    room = dot + tree.norm[:, None] * rd + data.norm * rq + rq * rd
    room += 1e-9 * (np.abs(dot) + (tree.norm[:, None] + rq) * (data.norm + rd)) + 1e-6

    def opened(nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([data.children[n] if not data.leaf[n] else [n] for n in nodes.tolist()]).astype(np.int64)

    def walk(a: int, nodes: np.ndarray) -> None:
        """Query node a against the data nodes that its parent couldn't drop."""
        rows = tree.rows(a)
        nodes = nodes[room[a, nodes] >= best.worst(rows).min()]
        if not len(nodes):
            return
        if not tree.leaf[a]:
            nodes = opened(nodes)
            for child in tree.children[a].tolist():
                walk(child, nodes)
            return
        while not data.leaf[nodes].all():
            nodes = opened(nodes)
            nodes = nodes[room[a, nodes] >= best.worst(rows).min()]
        nodes = nodes[np.argsort(-room[a, nodes], kind="stable")]
        while len(nodes):
            size = np.cumsum([data.hi[n] - data.lo[n] for n in nodes.tolist()])
            take = max(1, int(np.searchsorted(size, POINTS, side="right")))
            at = np.concatenate([data.rows(n) for n in nodes[:take].tolist()])
            for lo in range(0, len(at), 2 * POINTS):
                cut = at[lo: lo + 2 * POINTS]
                for r in range(0, len(rows), 256):
                    own = rows[r: r + 256]
                    s = q[own] @ d[cut].T
                    s[q_id[own][:, None] == d_id[cut]] = -np.inf
                    best.add(own, s, d_id[cut])
            nodes = nodes[take:]
            nodes = nodes[room[a, nodes] >= best.worst(rows).min()]

    walk(0, np.zeros(1, np.int64))
    return best.score, best.id


# --- Spark ------------------------------------------------------------------

def _matrix(blobs: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(blobs, pa.ChunkedArray):
        blobs = blobs.combine_chunks()
    return np.frombuffer(b"".join(blobs.to_pylist()), "<f8").reshape(len(blobs), dim)


def _blobs(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(m, "<f8")], pa.binary())


def _quantised(rows: pa.Array, dim: int, scale: float) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * x).reshape(len(rows), dim)


def _far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """At most n centers, each the point farthest from those before."""
    if not len(points):
        return points
    chosen = [int(np.einsum("ij,ij->i", points, points).argmin())]
    dist = np.linalg.norm(points - points[chosen[0]], axis=1)
    while len(chosen) < n and dist.max() > 0:
        chosen.append(int(dist.argmax()))
        dist = np.minimum(dist, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def _dealt(vectors: DataFrame, centers: np.ndarray, dim: int, scale: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sq = np.einsum("ij,ij->i", centers, centers)
        for b in batches:
            x = _quantised(b.column(1), dim, scale)
            near = np.concatenate([(sq - 2 * (x[i: i + 2048] @ centers.T)).argmin(axis=1) for i in range(0, len(x), 2048)]) \
                if len(x) else np.empty(0, np.int64)
            dist = np.linalg.norm(x - centers[near], axis=1) * (1 + 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), _blobs(x), pa.array(near.astype(np.int32)), pa.array(dist), b.column(2)],
                                             names=["id", "vec", "center", "dist", "row"])
    return vectors.mapInArrow(run, "id long, vec binary, center int, dist double, row long")


def _search(blocks: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """Cogroup blocks(block, part, id, vec) with queries(block, part, row, id,
    vec, kth) into (query_row, query_id, id, score)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "id", "score"]
        parts = []
        if left.num_rows and right.num_rows:
            d, d_id = _matrix(left["vec"], dim), left["id"].to_numpy()
            data = CoverTree(d)
            right = right.sort_by([("center", "ascending"), ("row", "ascending")])
            for lo in range(0, right.num_rows, QUERY_TREE):
                cut = right.slice(lo, QUERY_TREE)
                q, q_row, q_id, kth = _matrix(cut["vec"], dim), cut["row"].to_numpy(), cut["id"].to_numpy(), cut["kth"].to_numpy()
                score, ids = dual_search(q, q_id, kth, d, d_id, data, k)
                keep = (score > -np.inf) & (score >= kth[:, None])
                row, _ = np.nonzero(keep)
                whole = np.clip(score[keep], -2.0 ** 63, 2.0 ** 63 - 1025).astype(np.int64)
                parts.append(pa.Table.from_arrays([pa.array(q_row[row]), pa.array(q_id[row]), pa.array(ids[keep]), pa.array(whole)], names=names))
        empty = pa.table([pa.array([], pa.int64())] * 4, names=names)
        return pa.concat_tables([empty, *parts])
    return (blocks.groupBy("block", "part").cogroup(queries.groupBy("block", "part"))
            .applyInArrow(run, "query_row long, query_id long, id long, score long"))


def _one_dimension(vectors: DataFrame, is_query: Column, dim: int, k: int, scale: float) -> DataFrame:
    """``(query_id, id, score)``: for each row that is a query, its k best
    pairs at least."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).select("id", "vec").toArrow()
    points = _quantised(sample["vec"].combine_chunks(), dim, scale)
    centers = _far_apart(points, max(1, min(MAX_CENTERS, math.ceil(n / ROWS_PER_CENTER))))
    dealt = written(_dealt(vectors.select("id", "vec", "row"), centers, dim, scale), "dealt_vectors")
    # One row for each center: MAX_CENTERS at most.
    meta = {r.center: (r["n"], r.radius) for r in dealt.groupBy("center").agg(
        F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}
    first, cells, at = [0] * len(centers), [1] * len(centers), 0
    radius = np.full(len(centers), -np.inf)
    for c in range(len(centers)):
        rows, radius[c] = meta.get(c, (0, -np.inf))
        first[c], cells[c] = at, max(1, math.ceil(rows / BLOCK))
        at += cells[c]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("center") + 1)
    placed = dealt.withColumn("block", pick(first) + F.pmod(F.xxhash64("row"), pick(cells)).cast("int"))
    queries = placed.where(is_query)
    groups = max(1, math.ceil(queries.count() / QUERY_GROUP))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int")
    blocks = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("block", "part", "id", "vec")
    queries = queries.withColumn("part", part).select("block", "part", "row", "id", "vec", "center")

    own = written(_search(blocks, queries.withColumn("kth", F.lit(float("-inf"))), dim, k), "own_block_scores")
    kth = own.groupBy("query_row").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    queries = queries.join(kth, queries.row == kth.query_row, "left").select(
        "block", "part", "row", "id", "vec", "center", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf"))).alias("kth"))
    first_a, cells_a = np.array(first), np.array(cells)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each other block that may hold a score of kth or more."""
        for b in batches:
            t = pa.Table.from_batches([b])
            for lo in range(0, t.num_rows, 1024):
                cut = t.slice(lo, 1024)
                q, kth = _matrix(cut["vec"], dim), cut["kth"].to_numpy()
                dot, norm = q @ centers.T, np.linalg.norm(q, axis=1)[:, None]
                with np.errstate(invalid="ignore"):
                    room = dot + norm * radius + 1e-9 * (np.abs(dot) + norm * np.abs(radius)) + 1e-6
                row, c = np.nonzero((room >= kth[:, None]) & (radius >= 0))
                reps = cells_a[c]
                row = np.repeat(row, reps)
                block = np.repeat(first_a[c] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
                other = block != cut["block"].to_numpy()[row]
                got = cut.take(pa.array(row[other]))
                got = got.set_column(0, "block", pa.array(block[other].astype(np.int32)))
                yield from got.to_batches()

    wide = queries.mapInArrow(spread, queries.schema)
    rest = _search(blocks, wide, dim, k)
    return own.unionByName(rest).select("query_id", "id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: for each query (rows where
    ``is_query``, an expression over the column ``id``) the k other ids with
    the highest integer inner product of ``floor(scale * x)`` components, ties
    to the smaller id; all of them if there are fewer.

    Rows with a null id, a null vector or a null or non-finite component take
    no part. Every row counts, repeated ones as often as they are there: as a
    candidate it is a result of its own; rows of one query id share its k
    places and are not candidates of each other. Vectors are compared with vectors of their own length (at
    most MAX_DIMENSIONS lengths). Scores are exact up to 2**53. Other columns
    are ignored; an empty table, or no queries, gives an empty table.
    """
    x = F.col("vec")
    ok = x.isNotNull() & F.col("id").isNotNull() & F.forall(
        x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where(ok)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    dims = [r.n for r in rows.select(F.size("vec").alias("n")).distinct().limit(MAX_DIMENSIONS + 1).collect()]
    if len(dims) > MAX_DIMENSIONS:
        raise ValueError(f"vectors of more than {MAX_DIMENSIONS} lengths")
    out = rows.sparkSession.createDataFrame([], "query_id long, id long, score long")
    for dim in sorted(dims):
        out = out.unionByName(_one_dimension(rows.where(F.size("vec") == dim), is_query, dim, k, scale))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
