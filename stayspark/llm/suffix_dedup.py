"""Removal of repeated strings by distributed prefix doubling.

A byte is removed when it lies in a string of ``length`` bytes that also
starts in a document with a smaller id. Which positions start with equal
strings is found by prefix doubling: positions are sorted by (rank, rank at
the offset) pairs of 8, 16, 32, ... bytes and ranked anew; a position whose
pair is unique is dropped at once, and the last round reaches the threshold
by an offset that overlaps.

Spark splits that sort so that each bucket's rounds need no further shuffle.
Every string of ``length`` bytes has a class: the least hash of its 16-byte
grams. Equal strings have equal classes, and neighbouring positions mostly
share one, so a run of positions travels as one short segment of text. A
first shuffle finds the classes that more than one document has (about one
number for 18 bytes of text); only their segments are sent, each distinct one
once a block with its least document; a bucket ranks the positions of its
distinct segments. Classes with very many segments (a line or passage that a
large share of the corpus has) are dealt out by whole string instead, so that
equal strings still meet, collapsed, and others scatter.

Documents are packed into blocks of bounded size, stored once in a table
bucketed by block: all answers come back to it without moving the texts.
Whole copies of a smaller document are found first, by 128-bit digests of the
texts (each distinct one of a block is sent once, with its least id); all
their strings start in that document, so they are removed whole and send
nothing.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textbytes as B
from .common import ensure_checkpoint_dir, small_enough, wide, written

LENGTH = 50
GRAM = 16
#: Bytes of text in a block (a longer document is a block of its own).
BLOCK_BYTES = 1 << 20
#: Bytes of the corpus for each bucket of classes.
BUCKET_BYTES = 1 << 20
#: Occurrences of a class beyond which its strings are dealt out one by one.
HOT = 30_000
#: Positions of one class that travel as one segment.
RUN = 32

_MUL = np.uint64(0xC2B2AE3D27D4EB4F)


# --- prefix doubling ----------------------------------------------------------

def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys stand that are there more than once, and their ranks."""
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    rank = np.cumsum(~same[:-1], dtype=np.int32)
    more = same[:-1] | same[1:]
    return order[more], rank[more]


def equal_strings(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Prefix doubling over a text of segments that end at ``ends``:
    (positions, rank) of the strings of ``length`` bytes that start more than
    once; equal ranks, equal strings. ``length`` is at least 8."""
    n = len(text)
    size = np.diff(np.concatenate([[0], ends]))
    left = np.repeat(ends.astype(np.int32), size) - np.arange(n, dtype=np.int32)  # bytes to the segment's end
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.ndarray((n,), ">u8", buffer=padded.data, strides=(1,))
    at = np.flatnonzero(left >= 8).astype(np.int32)
    where, found = _repeated(word[at].astype(np.uint64))
    rank = np.zeros(n, np.int32)  # from 1; 0 where the string is unique or too short
    h = 8
    while True:
        at = at[where]
        if h == length:
            return at, found
        rank.fill(0)
        rank[at] = found
        step = min(h, length - h)
        at = at[left[at] >= h + step]
        second = rank[at + step]
        at, second = at[second > 0], second[second > 0]
        where, found = _repeated(rank[at].astype(np.int64) * (n + 1) + second)
        h += step


# --- blocks -------------------------------------------------------------------

_BLOCK = "block long, ids binary, live binary, starts binary, digests binary, data binary"


def tidy(run):
    """A group function that gives free memory back when it is done."""
    def wrapped(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        B.give_back()
        return out
    # applyInArrow reads the number of arguments.
    wrapped.__signature__ = inspect.signature(run)
    return wrapped


def _table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows as an Arrow table of a schema of ints, longs, booleans and binaries."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, k = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        ids = b.column(0)
        live = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        for lo, hi, data, starts in B.pieces(b.column(1), BLOCK_BYTES):
            text = data.tobytes()
            digests = b"".join(hashlib.blake2b(text[x:y], digest_size=16).digest() for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()))
            row = (base + k, ids[lo:hi].tobytes(), live[lo:hi].astype(np.uint8).tobytes(), starts.astype("<i8").tobytes(), digests, text)
            k += 1
            yield from _table([row], _BLOCK).to_batches()


class _Block:
    """A block's documents, and its runs of positions of one class."""

    def __init__(self, left: pa.Table, right: pa.Table, length: int):
        """``right`` may hold the smaller ids that other blocks have of the
        block's texts (bucket COPIES); without them ``copies`` are the
        block's own."""
        row = left.to_pylist()[0]
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.live = np.frombuffer(row["live"], np.uint8).astype(bool)
        self.named = self.live.copy()
        self.copies = np.zeros(len(self.ids), bool)
        named = np.flatnonzero(self.named)
        pick, number = _least_rows(np.frombuffer(row["digests"], "<u8").reshape(-1, 2)[named], self.ids[named])
        least = self.ids[named[pick]]
        elsewhere = _numbers(right, COPIES, ">i8").reshape(-1, 2)
        least[number[np.searchsorted(named, elsewhere[:, 0])]] = elsewhere[:, 1]
        self.copies[named] = self.ids[named] > least[number]
        self.live &= ~self.copies
        self.starts = np.frombuffer(row["starts"], "<i8")
        self.data = np.frombuffer(row["data"], np.uint8)
        self.length = length

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first position, positions, class, row) of each run."""
        n, span = len(self.data), self.length - GRAM + 1
        size = np.diff(self.starts)
        long = self.live & (size >= self.length)
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, self.starts[:-1][long], 1)
        np.add.at(step, self.starts[1:][long] - self.length + 1, -1)
        p = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int32) > 0).astype(np.int32)
        if not len(p):
            z = np.empty(0, np.int64)
            return z, z, z.astype(np.uint64), z
        padded = np.concatenate([self.data, np.zeros(GRAM + 8, np.uint8)])
        word = np.ndarray((n + 8,), "<u8", buffer=padded.data, strides=(1,))
        low = word[:n] * _MUL
        low += word[8: n + 8]
        low = B.mix(low)
        done = 1
        while done * 2 <= span:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        if span > done:
            low = np.minimum(low[: len(low) - (span - done)], low[span - done:])
        low = low[p]
        new = np.ones(len(p), bool)
        new[1:] = (low[1:] != low[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, len(p)))
        # Long runs (periodic texts) are cut.
        cuts = -(-runs // RUN)
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, runs = np.repeat(first, cuts) + RUN * k, np.minimum(np.repeat(runs, cuts) - RUN * k, RUN)
        at = p[first]
        # Least hashes are small numbers; mixed again they spread over the buckets.
        return at, runs, B.mix(low[first]), np.searchsorted(self.starts, at, side="right") - 1


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each run of a sorted array."""
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
        yield int(bucket[lo]), lo, hi


# --- whole copies ---------------------------------------------------------------

_ANSWER = "block long, bucket int, marks binary"
#: Bucket numbers of answers about a block's documents and its own row.
COPIES, OWN = -2, -1
#: Blocks of one digest beyond which its least id is sent to them, not they to it.
HOT_BLOCKS = 64
#: Most least ids that are sent to every task; more are joined by shuffle.
HOT_DIGESTS = 200_000
_DIGESTS = "digest binary, id long, block long, row int"


def _numbers(t: pa.Table, bucket: int, kind: str) -> np.ndarray:
    """The marks of one bucket number as an array."""
    marks = t.filter(pc.equal(t["bucket"], bucket))["marks"].to_pylist()
    return np.frombuffer(b"".join(marks), kind)


def _least_rows(digest: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the distinct digests with their least id, number of the
    distinct one of each row)."""
    order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
    d = digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]).any(axis=1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block to its distinct digests, each with its least id and that id's row."""
    for b in batches:
        for row in b.to_pylist():
            ids, digest = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["digests"], "<u8").reshape(-1, 2)
            rows = np.flatnonzero(np.frombuffer(row["live"], np.uint8))
            rows = rows[_least_rows(digest[rows], ids[rows])[0]]
            out = [(digest[r].tobytes(), int(ids[r]), row["block"], r) for r in rows.tolist()]
            yield from _table(out, _DIGESTS).to_batches()


def _copies(digests: DataFrame) -> DataFrame:
    """For each digest of a block that another block has with a smaller id:
    the block's row and that id (two big-endian numbers)."""
    least = digests.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("blocks"))
    least = written(least.where("least < most").select("digest", "least", "blocks"), "least_ids")
    hot, rest = least.where(F.col("blocks") > HOT_BLOCKS).select("digest", "least"), least.select("digest", "least")
    parts = []
    if small_enough(hot, HOT_DIGESTS):
        parts.append(digests.join(F.broadcast(hot), "digest"))
        rest = least.where(F.col("blocks") <= HOT_BLOCKS).select("digest", "least")
        digests = digests.join(F.broadcast(hot), "digest", "left_anti")
    parts.append(digests.join(rest, "digest"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    number = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 16, "0")
    return out.where("least < id").select("block", F.lit(COPIES).alias("bucket"), F.unhex(F.concat(number("row"), number("least"))).alias("marks"))


# --- classes that several documents have --------------------------------------

_COUNTS = "bucket int, block long, classes binary, counts binary"


def _counts_of(length: int, bits: int):
    """A block (without its copies) to its classes and their counts."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            block = _Block(left, right, length)
            _, _, h, r = block.classes()
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
            n = np.diff(np.append(first, len(h)))
            several = r[first + n - 1] != r[first] if len(first) else np.empty(0, bool)
            u = h[first]
            code = (np.minimum(n, 32_767) * 2 + several).astype("<u2")
            out = [(k, block.block, u[lo:hi].astype("<u8").tobytes(), code[lo:hi].tobytes()) for k, lo, hi in _slices(_bucket(u, bits))]
        return _table(out, _COUNTS)
    return run


def _mark(t: pa.Table) -> pa.Table:
    """For each class that a block sent: 0 if one document has it, 1 if
    several, 2 if it occurs more than HOT times."""
    parts = [np.frombuffer(x, "<u8") for x in t["classes"].to_pylist()]
    code = np.concatenate([np.frombuffer(x, "<u2") for x in t["counts"].to_pylist()]).astype(np.int64)
    _, at = np.unique(np.concatenate(parts), return_inverse=True)
    several = (np.bincount(at) > 1) | (np.bincount(at, code & 1) > 0)
    mark = several.astype(np.uint8) * np.where(np.bincount(at, code >> 1) > HOT, 2, 1).astype(np.uint8)
    mark = mark[at]
    edge = np.cumsum([0, *map(len, parts)])
    blobs = [mark[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
    return _table(list(zip(t["block"].to_pylist(), t["bucket"].to_pylist(), blobs)), _ANSWER)


# --- segments -----------------------------------------------------------------

_SEGMENTS = "bucket int, block long, own boolean, docs binary, sizes binary, text binary"


def _gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return data[np.repeat(at - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def _distinct(h: np.ndarray, g: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the distinct (h, g, size) with their least doc, number of the
    distinct one of each row), in the order of h."""
    order = np.lexsort((doc, size, g, h))
    a, b, c = h[order], g[order], size[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _segments_of(length: int, bits: int):
    """A block and the marks of its classes to its segments by bucket, and its
    own row that says which positions they stand for; that row goes through
    some bucket and comes back as it is."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block = _Block(left, right, length)
            at, runs, h, row = block.classes()
            marks = np.frombuffer(b"".join(right.filter(pc.greater_equal(right["bucket"], 0)).sort_by("bucket")["marks"].to_pylist()), np.uint8)
            _, inverse = np.unique(h, return_inverse=True)
            mark = marks[inverse]
            some, hot = mark == 1, mark == 2
            # A hot run is as many runs of one position.
            reps = runs[hot]
            each = np.repeat(at[hot], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            place = np.concatenate([at[some], each])
            count = np.concatenate([runs[some], np.ones(len(each), np.int64)])
            doc = block.ids[np.concatenate([row[some], np.repeat(row[hot], reps)])]
            size = count + length - 1
            g = B.hashes(block.data, place, place + size)
            key = np.concatenate([h[some], g[len(at[some]):]])
            pick, number = _distinct(key, g, size, doc)
            later = doc > doc[pick][number]
            keep = block.block
            own = b"".join([np.array([len(place)], "<i8").tobytes(), place.astype("<i4").tobytes(), count.astype(np.uint8).tobytes(),
                            number.astype("<i4").tobytes(), later.astype(np.uint8).tobytes(), np.flatnonzero(block.copies).astype("<i4").tobytes()])
            out.append((zlib.crc32(str(keep).encode()) % (1 << bits), keep, True, own, b"", b""))
            for k, lo, hi in _slices(_bucket(key[pick], bits)):
                cut = pick[lo:hi]
                out.append((k, keep, False, doc[cut].astype("<i8").tobytes(), size[cut].astype(np.uint8).tobytes(),
                            _gather(block.data, place[cut], size[cut]).tobytes()))
        return _table(out, _SEGMENTS)
    return run


def _judge(length: int):
    """For each segment that a block sent, a bit for each of its strings:
    whether a smaller document has it."""
    def run(t: pa.Table) -> pa.Table:
        own = t.filter(t["own"])
        back = _table([(block, OWN, docs) for block, docs in zip(own["block"].to_pylist(), own["docs"].to_pylist())], _ANSWER)
        t = t.filter(pc.invert(t["own"]))
        return pa.concat_tables([back, judged(t)]) if len(t) else back

    def judged(t: pa.Table) -> pa.Table:
        doc = np.concatenate([np.frombuffer(x, "<i8") for x in t["docs"].to_pylist()])
        parts = [np.frombuffer(x, np.uint8) for x in t["sizes"].to_pylist()]
        size = np.concatenate(parts).astype(np.int64)
        text = np.frombuffer(b"".join(t["text"].to_pylist()), np.uint8)
        end = np.cumsum(size)
        g = B.hashes(text, end - size, end)
        pick, number = _distinct(size.astype(np.uint64), g, size, doc)
        least = doc[pick]
        ends = np.cumsum(size[pick])
        at, rank = equal_strings(_gather(text, (end - size)[pick], size[pick]), ends, length)
        segment = np.searchsorted(ends, at, side="right")
        bits = np.zeros(len(pick), np.uint64)
        if len(at):
            order = np.argsort(rank, kind="stable")
            at, segment = at[order], segment[order]
            new = np.r_[True, np.diff(rank[order]) != 0]
            low = np.minimum.reduceat(least[segment], np.flatnonzero(new))
            smaller = low[np.cumsum(new) - 1] < least[segment]
            shift = (at - (ends - size[pick])[segment]).astype(np.uint64)
            np.bitwise_or.at(bits, segment[smaller], np.uint64(1) << shift[smaller])
        mask = np.where(doc > least[number], ~np.uint64(0), bits[number])
        edge = np.cumsum([0, *map(len, parts)])
        blobs = [mask[a:b].astype("<u8").tobytes() for a, b in zip(edge[:-1], edge[1:])]
        return _table(list(zip(t["block"].to_pylist(), t["bucket"].to_pylist(), blobs)), _ANSWER)
    return run


# --- result -------------------------------------------------------------------

_RESULT = "id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def _removed(length: int):
    """A block and its answers to one row per document."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        if left.num_rows:
            b = _Block(left, right, length)
            n = len(b.data)
            cover = np.zeros(n + 1, np.int32)
            if right.num_rows:
                own = right.filter(pc.equal(right["bucket"], OWN))["marks"].to_pylist()[0]
                m = int(np.frombuffer(own, "<i8", 1)[0])
                place = np.frombuffer(own, "<i4", m, 8).astype(np.int64)
                count = np.frombuffer(own, np.uint8, m, 8 + 4 * m).astype(np.int64)
                number = np.frombuffer(own, "<i4", m, 8 + 5 * m)
                later = np.frombuffer(own, np.uint8, m, 8 + 9 * m).astype(bool)
                copies = np.frombuffer(own, "<i4", -1, 8 + 10 * m) if len(own) > 8 + 10 * m else np.empty(0, np.int32)
                mask = right.filter(pc.greater_equal(right["bucket"], 0)).sort_by("bucket")["marks"].to_pylist()
                mask = np.frombuffer(b"".join(mask), "<u8")[number]
                mask = np.where(later, ~np.uint64(0), mask)
                some = mask != 0
                place, count, mask = place[some], count[some], mask[some]
                j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                hit = (np.repeat(mask, count) >> j.astype(np.uint64)) & np.uint64(1) > 0
                p = (np.repeat(place, count) + j)[hit]
                np.add.at(cover, p, 1)
                np.add.at(cover, p + length, -1)
                copies = copies[np.diff(b.starts)[copies] >= length]
                np.add.at(cover, b.starts[copies], 1)
                np.add.at(cover, b.starts[copies + 1], -1)
            gone = np.cumsum(cover[:-1]) > 0
            s, e, r = B.runs(gone, b.starts)
            kept_end = np.concatenate([[0], np.cumsum(~gone)])[b.starts]
            kept = b.data[~gone].tobytes()
            off = pa.array(np.searchsorted(r, np.arange(len(b.ids) + 1)).astype(np.int32))
            base = b.starts[r] if len(r) else np.empty(0, np.int64)
            spans = pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], names=["start", "end"])
            tables.append(pa.Table.from_arrays(
                [pa.array(b.ids, mask=~b.named), pa.array(np.diff(b.starts)), pa.ListArray.from_arrays(off, spans),
                 pa.array([kept[x:y] for x, y in zip(kept_end[:-1].tolist(), kept_end[1:].tolist())], pa.binary())],
                names=["id", "n_bytes", "removed", "kept"]))
        return pa.concat_tables(tables) if tables else _NOTHING
    return run


_NOTHING = pa.table({"id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()),
                     "removed": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     "kept": pa.array([], pa.binary())})


def _stored(blocks: DataFrame, spark: SparkSession) -> DataFrame:
    """The blocks as a table bucketed by block in the shared folder."""
    name = f"text_blocks_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stayspark/{name}"
    (blocks.write.format("parquet").option("path", path).option("compression", "zstd")
     .bucketBy(wide(spark), "block").sortBy("block").saveAsTable(name))
    return spark.table(name)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, removed, kept)``, one row per row of ``docs``: the
    removed byte ranges (maximal, end exclusive) and the bytes that stay.

    Strings are judged on the input; they never cross documents; rows with
    equal ids don't remove each other. Null texts are empty; a null id is
    neither smaller nor larger than any. Other columns are ignored; an empty
    table gives an empty table. ``length`` is 24 to 50.
    """
    if not GRAM + 8 <= length <= LENGTH:
        raise ValueError("length is 24 to 50")
    spark = docs.sparkSession
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _stored(kept.mapInArrow(B.lean(_block_batches), _BLOCK), spark)
    total = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    bits = max(0, int(total // BUCKET_BYTES).bit_length())
    # Only the ids and digests of the blocks are read for this.
    digests = written(blocks.select("block", "ids", "live", "digests").mapInArrow(B.lean(_digest_batches), _DIGESTS), "digests")
    copies = written(_copies(digests), "copies")

    def with_block(answers: DataFrame, run, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy(run), schema)

    counts = with_block(copies, _counts_of(length, bits), _COUNTS)
    marks = counts.groupBy("bucket").applyInArrow(tidy(_mark), _ANSWER)
    sent = with_block(marks.unionByName(copies), _segments_of(length, bits), _SEGMENTS)
    answers = sent.groupBy("bucket").applyInArrow(tidy(_judge(length)), _ANSWER)
    return with_block(answers, _removed(length), _RESULT)
