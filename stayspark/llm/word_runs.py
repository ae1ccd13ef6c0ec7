"""Periodic runs of words, found on tiles scaled to the period.

Periods are taken octave by octave: S = 1, 2, 4, ... stands for the periods S
to 2S - 1, and an octave's documents are cut into tiles whose cores are S
words long. A run of four periods covers whole cores, so a tile has to answer
only for its own core: for which periods q of the octave does the core equal
the S words q further on? Boundary Z-functions (how far the words right of
the core's end, and left of its start, equal those q words on) then widen the
core to an interval fragment. Windows of 2, 4, 8, ... words have exact
names (equal windows, equal name), so that a Z value is a descent over
the names and all tiles of an octave are solved at once in numpy.

Tiles of a document of up to ``LONG`` words are solved where it is read; a
longer one is exploded into rows of tiles (with the words they need) that are
dealt to other tasks. Fragments, a few numbers each, are shuffled by document
and period and stitched by DataFrame windows; runs go back to the documents
that have any. Texts are written once and only documents with fragments
are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import textbytes as B
from .common import wide, written

#: Words of the longest document whose tiles are solved where it is read, and least words of a row of tiles.
LONG = 1 << 17
PIECE_BYTES = 1 << 20
LEAST_WORDS = 6
LEAST_PERIODS = 4

_RUN = "struct<start:long,length:long,period:long>"


# --- tiles ------------------------------------------------------------------

class Names:
    """Exact names of the windows of 1, 2, 4, ... words of some documents:
    ``level[k][i]`` names the 2**k words from i on, -1 where they would leave
    the document, or at its end mark."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        n = len(codes)
        self.bounds = bounds
        self.end = np.repeat(bounds[1:], np.diff(bounds))
        self.words = np.repeat(np.diff(bounds), np.diff(bounds))
        first = np.full(n + 1, -1, np.int32)
        first[:n] = codes
        self.level = [first]
        self._at = np.arange(n)

    def grow(self) -> None:
        """Names of windows twice as long, in documents that can hold four
        periods of that length."""
        size = 1 << (len(self.level) - 1)
        at = self._at
        at = self._at = at[(at + 2 * size <= self.end[at]) & (self.words[at] >= LEAST_PERIODS * 2 * size)]
        last = self.level[-1]
        pair = last[at].astype(np.int64) << 32 | last[at + size]
        out = np.full(len(last), -1, np.int32)
        out[at] = pd.factorize(pair)[0]
        self.level.append(out)

    def _named(self, k: int, at: np.ndarray) -> np.ndarray:
        return self.level[k][np.minimum(at, len(self.level[k]) - 1)]

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i equal those from j (n > 0)."""
        out = np.zeros(len(i), bool)
        k = np.floor(np.log2(n)).astype(np.int64)
        for x in np.unique(k):
            m = np.flatnonzero(k == x)
            a, b, rest = i[m], j[m], n[m] - (1 << int(x))
            names = self.level[int(x)]
            out[m] = (names[a] == names[b]) & (names[a + rest] == names[b + rest])
        return out

    def right(self, at: np.ndarray, q: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        """Boundary Z values to the right: words from ``at`` on that equal
        those q on, up to three times 2**k of them."""
        z = np.zeros(len(at), np.int64)
        for x in [k, *range(k, -1, -1)]:
            i = at + z
            ok = (i + q + (1 << x) <= end) & (self._named(x, i) == self._named(x, i + q))
            z += np.where(ok, 1 << x, 0)
        return z

    def left(self, at: np.ndarray, q: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
        """The same for the words before ``at``."""
        z = np.zeros(len(at), np.int64)
        for x in [k, *range(k, -1, -1)]:
            i = at - z - (1 << x)
            ok = i >= start
            i = np.maximum(i, 0)
            ok &= self._named(x, i) == self._named(x, i + q)
            z += np.where(ok, 1 << x, 0)
        return z


def _least_prime(n: int) -> np.ndarray:
    out = np.arange(n + 1)
    for p in range(2, int(n ** 0.5) + 1):
        if out[p] == p:
            out[p * p:: p] = np.minimum(out[p * p:: p], p)
    return out


def solve(names: Names, k: int, tile: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tile index, period, from, to) of the fragments of an octave's tiles:
    the words ``from .. to`` equal those one period on. ``tile`` holds the
    cores' first words, ``start`` and ``end`` bound their documents.
    Periods that are a multiple of a smaller one are left out."""
    size = 1 << k
    on = tile[:, None] + size + np.arange(size)
    hit = names._named(k, on) == names.level[k][tile][:, None]
    hit &= on + size <= end[:, None]
    t, j = np.nonzero(hit)
    q = j + size
    # w[b .. b+q) has to be primitive: no period q / p that divides it
    least, rest = _least_prime(2 * size), q.copy()
    while len(t) and (rest > 1).any():
        p = least[rest]
        b, shift = tile[t], q // np.maximum(p, 1)
        whole = np.flatnonzero(rest > 1)
        power = np.zeros(len(t), bool)
        power[whole] = names.same(b[whole], (b + shift)[whole], (q - shift)[whole])
        t, q, rest = t[~power], q[~power], (rest // np.maximum(p, 1))[~power]
    b = tile[t]
    z = names.right(b + size, q, end[t], k)
    y = names.left(b, q, start[t], k)
    keep = y + size + z >= (LEAST_PERIODS - 1) * size
    return t[keep], q[keep], (b - y)[keep], (b + size + z)[keep]


def _stitched(doc: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Touching fragments of a document and period made one."""
    order = np.lexsort((hi, lo, q, doc))
    doc, q, lo, hi = doc[order], q[order], lo[order], hi[order]
    if not len(doc):
        return doc, q, lo, hi
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (q[1:] != q[:-1])
    group = np.cumsum(other) - 1
    span = int(hi.max()) + 1
    reach = np.maximum.accumulate(group * span + hi) - group * span
    new = other.copy()
    new[1:] |= lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], q[first], lo[first], reach[last]


def fragments(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, period, from, to) of whole documents: word codes, one
    document after another, cut at ``bounds``; places count from the
    document's first word."""
    names, n = Names(codes, bounds), np.diff(bounds)
    found, k = [], 0
    while True:
        size = 1 << k
        docs = np.flatnonzero(n >= max(LEAST_WORDS, LEAST_PERIODS * size))
        if not len(docs):
            break
        tiles = (n[docs] - 2 * size) // size + 1
        doc = np.repeat(docs, tiles)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        t, q, lo, hi = solve(names, k, bounds[doc] + nth * size, bounds[doc], bounds[doc + 1])
        d = doc[t]
        found.append(_stitched(d, q, lo - bounds[d], hi - bounds[d]))
        k += 1
        names.grow()
    if not found:
        found = [(np.empty(0, np.int64),) * 4]
    return tuple(np.concatenate(x) for x in zip(*found))


def tile_rows(codes: np.ndarray, long: int = LONG) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """A long document's tiles, by octave: (octave, first core word, words
    before it, codes). The words beside the cores are those that Z values may
    reach."""
    n, k = len(codes), 0
    while n >= max(LEAST_WORDS, LEAST_PERIODS << k):
        size = 1 << k
        core = max(long, 16 * size)
        for at in range(0, n, core):
            lo = max(0, at - 3 * size)
            yield k, at, at - lo, codes[lo: min(n, at + core + 6 * size)]
        k += 1


def _solve_rows(long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, period, start, end) of rows of tiles."""
        for b in batches:
            for i in range(b.num_rows):
                row, k, at, before, blob = (b.column(c)[i].as_py() for c in range(5))
                codes = np.frombuffer(blob, np.int32)
                # the window's own ends may cut a Z value short, never lengthen it
                names = Names(codes, np.array([0, len(codes)]))
                names.words = np.full(len(codes), np.iinfo(np.int64).max)
                for _ in range(k):
                    names.grow()
                size = 1 << k
                tile = np.arange(before, min(len(codes) - 2 * size + 1, before + max(long, 16 * size)), size)
                ends = np.zeros(len(tile), np.int64), np.full(len(tile), len(codes))
                t, q, lo, hi = solve(names, k, tile, *ends)
                _, q, lo, hi = _stitched(np.zeros(len(t), np.int64), q, lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row, np.int64)), pa.array(q), pa.array(lo + at - before), pa.array(hi + at - before)],
                                                 ["row", "period", "start", "end"])
    return run


# --- documents --------------------------------------------------------------

def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exact codes of the words, documents' bounds in them)."""
    inside = ~B.SPACE[data]
    s, e, row = B.runs(inside, starts)
    bounds = np.searchsorted(row, np.arange(len(starts)))
    if not len(s):
        return np.empty(0, np.int32), bounds
    offsets = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=offsets[1:])
    packed = np.ascontiguousarray(data[inside])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32), bounds


def _document_batches(long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (its words, one space between them, and its
        fragments), and a row for each row of tiles of long documents."""
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            id_type = b.schema.field(0).type
            for lo, hi, data, starts in B.pieces(b.column(1), PIECE_BYTES):
                codes, bounds = _words(data, starts)
                n = np.diff(bounds)
                short = n <= long
                raw, cut = data.tobytes(), starts.tolist()
                text = [b" ".join(raw[x:y].split()).decode() for x, y in zip(cut, cut[1:])]
                few = np.where(short, n, 0)
                doc, q, a, z = fragments(codes[np.repeat(short, n)], np.concatenate([[0], np.cumsum(few)]))
                order = np.argsort(doc, kind="stable")
                at = np.searchsorted(doc[order], np.arange(len(n) + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(
                    [pa.array(x[order]) for x in (q, a, z)], names=["period", "start", "end"]))
                none = [pa.nulls(len(n), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(text, pa.string()), found, *none], _NAMES)
                for i in np.flatnonzero(~short):
                    for k, core, before, part in tile_rows(codes[bounds[i]: bounds[i + 1]], long):
                        empty = [pa.nulls(1, t) for t in (id_type, pa.int64(), pa.string(), found.type)]
                        yield pa.RecordBatch.from_arrays([pa.array([row + int(i)]), *empty, pa.array([k], pa.int32()), pa.array([core]), pa.array([before]),
                                                          pa.array([part.tobytes()], pa.binary())], _NAMES)
                row += len(n)
    return run


_NAMES = ["row", "id", "n_words", "text", "found", "octave", "core", "before", "codes"]


def _collapse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that a run repeats."""
    for b in batches:
        runs = b.column(2)
        flat, off = runs.flatten(), runs.offsets.to_numpy() - runs.offsets[0].as_py()
        start, length, period = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
        kept = []
        for i in range(b.num_rows):
            words = b.column(3)[i].as_py().split(" ")
            change = np.zeros(len(words) + 1, np.int64)
            mine = slice(off[i], off[i + 1])
            np.add.at(change, start[mine] + period[mine], 1)
            np.add.at(change, start[mine] + length[mine], -1)
            stays = np.cumsum(change[:-1]) == 0
            kept.append(" ".join([words[w] for w in np.flatnonzero(stays)]))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(kept, pa.string())], ["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """``(id, n_words, runs, collapsed)``, one row per row of ``docs``.

    Words are what lies between blanks (space, tab to carriage return),
    numbered from 0. ``runs`` holds every stretch with smallest period q (words
    q apart are equal) of at least max(6, 4 q) words that no neighbouring word
    extends, as (start, length, period) by start, then period. ``collapsed``
    are the words, joined by one space, without those that lie in a run after
    the run's first q words.

    Null and empty texts have no words; repeated rows get a row each; null ids
    stay null; other columns are ignored; an empty table gives an empty table.
    Documents of more than ``long`` words are solved in rows of tiles.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()
    read = written(kept.mapInArrow(B.lean(_document_batches(long)),
                                   f"row long, id {id_type}, n_words long, text string, found array<struct<period:long,start:long,end:long>>, "
                                   "octave int, core long, before long, codes binary"), "word_run_documents")
    documents = read.where(F.col("octave").isNull())
    tiles = read.where(F.col("octave").isNotNull()).select("row", "octave", "core", "before", "codes").repartition(wide(docs.sparkSession), "row", "octave", "core")
    found = documents.select("row", F.explode("found").alias("f")).select("row", "f.*").unionByName(
        tiles.mapInArrow(B.lean(_solve_rows(long)), "row long, period long, start long, end long"))

    # Stitch: a fragment that starts beyond all before it starts a run.
    ordered = Window.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))
    runs = (found.withColumn("opens", opens).withColumn("nth", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("row", "period", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .withColumn("length", F.col("end") - F.col("start") + F.col("period"))
            .where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period"))))
    # A document's runs; no more than its words.
    runs = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs")).withColumnRenamed("row", "of")
    none = F.array().cast(f"array<{_RUN}>")
    asked = (F.size("found") > 0) | (F.col("n_words") > long)
    repeated = documents.where(asked).join(runs, F.col("row") == F.col("of"), "left").select("id", "n_words", F.coalesce("runs", none).alias("runs"), "text")
    schema = f"id {id_type}, n_words long, runs array<{_RUN}>, collapsed string"
    return (documents.where(~asked).select("id", "n_words", none.alias("runs"), F.col("text").alias("collapsed"))
            .unionByName(repeated.mapInArrow(B.lean(_collapse_batches), schema)))
