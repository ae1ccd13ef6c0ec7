"""Centroid clustering over a VA-file (vector approximations).

Vectors are cut to integers once and written in blocks: the integers, and for
each dimension a cell number of a few bits (the VA-file proper, a quarter of
the vectors' size or less). A round of k-means reads the cells alone. Lookup tables (dimension,
cell -> least and greatest contribution) add up to an interval for the
distance to each centroid; distances are taken relative to that of the
centroids' middle point, which leaves their order as it is and keeps the
intervals narrow. A vector whose nearest centroid the intervals settle needs
no more; the full vector is fetched, block by block, only where intervals
overlap or where the settled centroid isn't that of the round before.

Sums of the clusters are carried from round to round: only vectors that move
change them, so a round sends one row of sums for each cluster and batch, and
k rows reach the driver. All arithmetic is on integers and exact, so the
result doesn't depend on how the rows are dealt. Rounds keep no state but the
centroids: a lost task reads its blocks again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ensure_checkpoint_dir, wide, written
from .textbytes import lean

#: Vectors of a block; rows that the cells' bounds are chosen on.
BLOCK = 1024
SAMPLE_ROWS = 4096
#: Bits of a cell.
BITS = 8
#: Components (as integers) below this are taken, so that 64-bit sums are exact.
LIMIT = 1 << 27

_SUMS = "cluster int, n long, fetched long, sums array<long>"


# --- the VA-file ------------------------------------------------------------

def _bounds(sample: np.ndarray, dims: int, bits: int) -> np.ndarray:
    """(dims, cells - 1) inner bounds of the cells: quantiles of the sample, so
    that cells hold about equally many values. Any bounds give right results."""
    q = np.arange(1, 1 << bits) / (1 << bits)
    if not len(sample):
        return np.zeros((dims, len(q)), np.int64)
    return np.sort(np.quantile(sample, q, axis=0).T.round().astype(np.int64), axis=1)


def _block_batches(bounds: np.ndarray):
    dims = len(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, ids, cells, ends, vecs): ``ends`` are the least and the
        greatest component of the block, the outer bounds of its outer cells."""
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                cut = b.slice(lo, BLOCK)
                v = _ints(cut.column(1), dims)
                cells = np.empty(v.shape, np.uint8)
                for d in range(dims):
                    cells[:, d] = np.searchsorted(bounds[d], v[:, d], side="right")
                ends = np.concatenate([v.min(0), v.max(0)])
                ids = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), cut.column(0))
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (cells, ends.astype(np.int32), v.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, *blobs], ["block", "ids", "cells", "ends", "vecs"])
                block += 1
    return run


def _ints(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class _Tables:
    """Lookup tables of one set of centroids. What is sent to the tasks are
    the centroids and the cells' bounds; each makes the tables for itself."""

    def __init__(self, centroids: np.ndarray, bounds: np.ndarray):
        self.c = centroids
        self.bounds = bounds
        middle = centroids.sum(0) // len(centroids)
        # |v - c|^2 - |v - m|^2 = base - 2 v (c - m): linear in each component
        self.slope = -2 * (centroids - middle)
        self.base = (centroids ** 2).sum(1) - (middle ** 2).sum()
        low = np.concatenate([bounds[:, :1], bounds], axis=1)
        high = np.concatenate([bounds - 1, bounds[:, -1:]], axis=1)
        self.least, self.most = self._span(low, high)

    def __reduce__(self):
        return _Tables, (self.c, self.bounds)

    def _span(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = low[:, :, None] * self.slope.T[:, None, :]
        b = high[:, :, None] * self.slope.T[:, None, :]
        return np.minimum(a, b), np.maximum(a, b)

    def intervals(self, cells: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, centroids) least and greatest relative distances."""
        dims, last = cells.shape[1], self.bounds.shape[1]
        least, most = self.least.copy(), self.most.copy()
        # the outer cells end where the block's components do
        for cell, low, high in ((0, ends[:dims], self.bounds[:, 0] - 1), (last, self.bounds[:, -1], ends[dims:])):
            lo, hi = self._span(low[:, None], high[:, None])
            least[:, cell], most[:, cell] = lo[:, 0], hi[:, 0]
        lo = np.repeat(self.base[None, :], len(cells), axis=0)
        hi = lo.copy()
        for d in range(dims):
            lo += least[d][cells[:, d]]
            hi += most[d][cells[:, d]]
        return lo, hi

    def settled(self, cells: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The nearest centroid where the intervals leave one, else -1."""
        lo, hi = self.intervals(cells, ends)
        best = hi.argmin(1)
        rest = lo
        rest[np.arange(len(lo)), best] = np.iinfo(np.int64).max
        return np.where(hi[np.arange(len(hi)), best] < rest.min(1), best, -1)

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """Exact; ties go to the smaller number."""
        return ((self.c ** 2).sum(1)[None, :] - 2 * (v @ self.c.T)).argmin(1)

    def distance(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((v - self.c[cluster]) ** 2).sum(1)

    def place(self, cells: np.ndarray, ends: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Nearest centroids: full vectors only where intervals overlap."""
        at = self.settled(cells, ends)
        open_ = np.flatnonzero(at < 0)
        at[open_] = self.nearest(v[open_])
        return at


def _shape(cells: bytes, ends: bytes, vecs: bytes | None, dims: int):
    return (np.frombuffer(cells, np.uint8).reshape(-1, dims), np.frombuffer(ends, np.int32).astype(np.int64),
            None if vecs is None else np.frombuffer(vecs, np.int32).reshape(-1, dims).astype(np.int64))


def _sum_rows(cluster: np.ndarray, v: np.ndarray, sign: np.ndarray, fetched: int) -> pa.RecordBatch:
    """One row of signed sums for each cluster met."""
    met = np.unique(cluster)
    sums, n = [], []
    for c in met:
        of = cluster == c
        sums.append((v[of] * sign[of, None]).sum(0))
        n.append(int(sign[of].sum()))
    return pa.RecordBatch.from_arrays(
        [pa.array(met.astype(np.int32)), pa.array(n, pa.int64()), pa.array([fetched] + [0] * (len(met) - 1) if len(met) else [], pa.int64()),
         pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], ["cluster", "n", "fetched", "sums"])


def _first_sums(tables: _Tables):
    dims = tables.c.shape[1]

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                cells, ends, v = _shape(*(b.column(c)[row].as_py() for c in range(3)), dims)
                at = tables.place(cells, ends, v)
                yield _sum_rows(at, v, np.ones(len(v), np.int64), 0)
    return run


def _wanted(old: _Tables, new: _Tables):
    dims = old.c.shape[1]

    def run(batches):
        """(block, at): places of the vectors that must be fetched."""
        for b in batches:
            blocks, ats = [], []
            for row in range(b.num_rows):
                cells, ends, _ = _shape(b.column(1)[row].as_py(), b.column(2)[row].as_py(), None, dims)
                was, now = old.settled(cells, ends), new.settled(cells, ends)
                at = np.flatnonzero((was != now) | (now < 0))
                if len(at):
                    blocks.append(b.column(0)[row].as_py())
                    ats.append(at.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(ats, pa.binary())], ["wanted", "at"])
    return run


def _moves(old: _Tables, new: _Tables):
    dims = old.c.shape[1]

    def run(batches):
        """What the fetched vectors take from one cluster and add to another."""
        for b in batches:
            for row in range(b.num_rows):
                at = np.frombuffer(b.column(0)[row].as_py(), np.int32)
                v = np.frombuffer(b.column(1)[row].as_py(), np.int32).reshape(-1, dims)[at].astype(np.int64)
                was, now = old.nearest(v), new.nearest(v)
                moved = was != now
                ones = np.ones(int(moved.sum()), np.int64)
                v = v[moved]
                got = _sum_rows(np.concatenate([was[moved], now[moved]]), np.concatenate([v, v]), np.concatenate([-ones, ones]), len(at))
                if not got.num_rows:
                    got = _sum_rows(np.zeros(1, np.int64), np.zeros((1, dims), np.int64), np.zeros(1, np.int64), len(at))
                yield got
    return run


def _final(tables: _Tables):
    dims = tables.c.shape[1]

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                cells, ends, v = _shape(*(b.column(c)[row].as_py() for c in range(1, 4)), dims)
                at = tables.place(cells, ends, v)
                yield pa.RecordBatch.from_arrays([b.column(0)[row].values, pa.array(at.astype(np.int32)), pa.array(tables.distance(v, at))],
                                                 ["id", "cluster", "distance"])
    return run


# --- rounds -----------------------------------------------------------------

def _added(rows: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums, counts and fetched vectors of all clusters: k rows to the driver."""
    got = rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("fetched").alias("fetched"),
                                      F.array(*[F.sum(F.col("sums")[d]) for d in range(dims)]).alias("sums")).collect()
    sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in got:
        sums[r.cluster], n[r.cluster] = r.sums, r.n
    return sums, n, sum(r.fetched for r in got)


def _stored(blocks: DataFrame, spark: SparkSession) -> DataFrame:
    """The blocks as a table bucketed by block in the shared folder, so that
    the fetch moves places, not vectors."""
    name = f"va_file_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stayspark/{name}"
    (blocks.write.format("parquet").option("path", path).option("compression", "zstd")
     .bucketBy(wide(spark), "block").sortBy("block").saveAsTable(name))
    return spark.table(name)


def _usable(vec: Column, dims: int) -> Column:
    return vec.isNotNull() & (F.size(vec) == dims) & F.forall(
        vec, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: str = "3", bits: int = BITS,
            id_col: str = "vec_id", vector_col: str = "embedding", told: list | None = None) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``
    for every vector of exactly ``dims`` components, none null or non-finite,
    cut to ``floor(scale * x)``; other rows are left out.

    Centroids start as the ``k`` vectors with the smallest lowercase-hex
    sha256 of ``<seed>:<id>`` (fewer, if there are fewer vectors; ties by the
    vector's integers; a null id is last). In each round every vector goes to
    the nearest centroid (squared Euclidean distance, ties to the smaller
    number) and a non-empty centroid becomes floor(sum / count) of its
    vectors; empty ones stay. A last assignment follows. Rounds stop early
    only when no centroid moves, which changes nothing.

    Rows are rows: a repeated id, or a repeated vector, counts as often as it
    is there. Integers of 2**27 or more in size are an error, not a rounded
    result. Other columns are ignored; an empty table gives an empty table.
    ``told``, if given, gets the number of vectors fetched in each round after
    the first.
    """
    if not 1 <= bits <= 8:
        raise ValueError("cells have 1 to 8 bits")
    spark = vectors.sparkSession
    whole = F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    too_large = F.exists("vec", lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) >= LIMIT - 1)
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).where(_usable(F.col("vec"), dims)).select(
        "id", F.when(too_large, F.raise_error(F.lit(f"a component beyond {LIMIT} after scaling")).cast("array<bigint>")).otherwise(whole).alias("vec"))
    id_type = kept.schema["id"].dataType.simpleString()
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last(), "vec").limit(k).select("vec").collect()
    if not first:
        return spark.createDataFrame([], f"id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.vec for r in first], np.int64)
    k = len(centroids)
    sample = kept.orderBy(F.xxhash64("id", "vec"), "vec").limit(SAMPLE_ROWS).select("vec").toArrow()["vec"].combine_chunks()
    bounds = _bounds(_ints(sample, dims), dims, bits)
    blocks = _stored(kept.mapInArrow(lean(_block_batches(bounds)), f"block long, ids array<{id_type}>, cells binary, ends binary, vecs binary"), spark)

    tables = _Tables(centroids, bounds)
    sums, n, _ = _added(blocks.select("cells", "ends", "vecs").mapInArrow(lean(_first_sums(tables)), _SUMS), k, dims)
    for done in range(rounds):
        moved = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], tables.c)
        if (moved == tables.c).all():
            break
        old, tables = tables, _Tables(moved, bounds)
        if done == rounds - 1:
            break
        wanted = blocks.select("block", "cells", "ends").mapInArrow(lean(_wanted(old, tables)), "wanted long, at binary")
        fetched = blocks.select("block", "vecs").join(wanted, F.col("block") == F.col("wanted")).select("at", "vecs")
        more, more_n, count = _added(fetched.mapInArrow(lean(_moves(old, tables)), _SUMS), k, dims)
        sums, n = sums + more, n + more_n
        if told is not None:
            told.append(count)

    placed = written(blocks.select("ids", "cells", "ends", "vecs").mapInArrow(
        lean(_final(tables)), f"id {id_type}, cluster int, distance long"), "placed_vectors")
    inertia = {r.cluster: r.d for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in tables.c.tolist()]
    # One row for each centroid.
    facts = spark.createDataFrame([(c, inertia[c], total, digest[c]) for c in sorted(inertia)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
