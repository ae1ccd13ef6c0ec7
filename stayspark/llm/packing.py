"""Best-fit packing of tokenised documents into sequences, after
Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the packing problem is the
histogram of lengths: at most ``capacity`` numbers, whatever the corpus. The
reduction permanently fixes sets of at most three pieces that provably
dominate every other way to fill the largest piece's sequence; what is left
is packed best-fit decreasing. Both work on whole groups of equal pieces and
give a plan of segments: pieces of this length and these ranks go to those
sequences at that offset. Pieces get their rank among equal lengths by a
distributed count, and look their place up in the plan.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import textbytes as B
from .common import wide, written

CAPACITY = 4096
END_ID = 1
#: Units of text that a worker remembers the ids of (twice as many at most), and the longest such unit in bytes.
CACHED_WORDS = 200_000
CACHED_BYTES = 64
#: Simple words tokenised as one text.
WORDS_AT_ONCE = 256
#: Bytes of text tokenised at once.
TEXT_BYTES = 2 << 20


# --- tokens -----------------------------------------------------------------

_LETTER = B.byte_set((65, 90), (97, 122))
_ASCII = B.byte_set((0, 127))
_WHOLE = B.byte_set((39, 39), (60, 60))  # ' of contractions, < of special tokens
_KEEP_CASE = B.byte_set((60, 60), (128, 255))
#: Whether a unit is letters that the normalizer leaves alone but for A-Z (the bytes C3 9F to C3 BF are small letters, save C3 B7).
_SIMPLE = re.compile(rb"(?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Tokenizers of this Python worker, with the words that they know, by path.
_open: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of whole texts, each distinct unit tokenised once.

    For tokenizers that lower the case, drop white space and take runs of
    letters, digits and other characters apart, as this vocabulary's does. A
    unit is a word cut where an ASCII letter meets another ASCII character.
    Words with an apostrophe or a ``<`` stay whole (contractions, special
    tokens); those with ``<`` or other than ASCII keep their case.

    Units of ASCII letters and small letters of Latin-1 alone are a word each
    to the tokenizer, whose normalizer only lowers their ASCII letters: many
    are tokenised as one text, split at spaces, and take their ids up to each
    that ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        # The same model behind a split at spaces alone, and the ids that end a word.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "),
                                                            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def opened(path: str) -> "WordTokenizer":
        if path not in _open:
            _open[path] = WordTokenizer(path)
        return _open[path]

    def units(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit as bytes of unsigned 32-bit numbers."""
        if len(self.known) > CACHED_WORDS:
            # What was used since the last turn stays; the rest goes at the next one.
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        got = list(map(known.get, units))
        new = []
        for i in [i for i, ids in enumerate(got) if ids is None]:
            ids = older.get(units[i])
            if ids is None:
                new.append(i)
            else:
                got[i] = known[units[i]] = ids
        simple = [i for i in new if _SIMPLE(units[i])]
        for lo in range(0, len(simple), 20_000):
            part = simple[lo: lo + 20_000]
            lines = [b" ".join([units[i] for i in part[k: k + WORDS_AT_ONCE]]).lower().decode() for k in range(0, len(part), WORDS_AT_ONCE)]
            flat = array("I")
            for e in self.words.encode_batch_fast(lines, add_special_tokens=False):
                flat.extend(e.ids)
            blob = flat.tobytes()
            ends = ((np.flatnonzero(self.last[np.frombuffer(flat, np.uint32)]) + 1) * 4).tolist()
            for i, a, z in zip(part, [0, *ends[:-1]], ends, strict=True):
                got[i] = ids = blob[a: z]
                if len(units[i]) <= CACHED_BYTES:
                    known[units[i]] = ids
        other = [i for i in new if got[i] is None]
        for lo in range(0, len(other), 20_000):
            part = other[lo: lo + 20_000]
            found = self.tokenizer.encode_batch_fast([units[i].decode() for i in part], add_special_tokens=False)
            for i, e in zip(part, found):
                got[i] = ids = array("I", e.ids).tobytes()
                if len(units[i]) <= CACHED_BYTES:
                    known[units[i]] = ids
        return got

    def texts(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, starts of the rows' ids plus the end)."""
        inside = ~B.SPACE[data]
        s, e, row = B.runs(inside, starts)
        if not len(s):
            return np.empty(0, np.uint32), np.zeros(len(starts), np.int64)
        text = data[inside]
        size = e - s
        word = np.cumsum(size) - size
        words = np.searchsorted(row, np.arange(len(starts)))
        del inside, s, e, row
        cut = self._cuts(text, word, size)
        kept = np.repeat(np.logical_or.reduceat(_KEEP_CASE[text], word), size)
        text = np.where(kept, text, B.LOWER[text])
        first = np.flatnonzero(cut)
        del cut, kept
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(text))), pa.py_buffer(text)])
        # Words before each row, units before each of those words.
        before = np.searchsorted(first, np.append(word, len(text))[words])
        del size, word, first
        coded = units.dictionary_encode()
        del units, text
        ids = self.units(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()
        del coded
        n_of = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), np.uint32)
        del ids
        n = n_of[at]
        end = np.cumsum(n, dtype=np.int64)
        # the place of every id, from that of its unit's first
        shift = (np.cumsum(n_of, dtype=np.int64) - n_of)[at] - (end - n)
        out = np.repeat(shift, n)
        out += np.arange(end[-1])
        return flat[out], np.concatenate([[0], end])[before]

    @staticmethod
    def _cuts(text: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where a unit starts."""
        letter, plain = _LETTER[text], _ASCII[text]
        cut = np.zeros(len(text), bool)
        cut[1:] = (letter[1:] != letter[:-1]) & plain[1:] & plain[:-1]
        whole = _WHOLE[text]
        if whole.any():
            cut &= ~np.repeat(np.logical_or.reduceat(whole, word), size)
        cut[word] = True
        return cut


def _piece_batches(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.opened(path)
        for b in batches:
            for lo, hi, data, starts in B.pieces(b.column(1), TEXT_BYTES):
                ids, at = tok.texts(data, starts)
                rows, piece, start, length, blobs = [], [], [], [], []
                for k in range(hi - lo):
                    own = np.append(ids[at[k]: at[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for p, a in enumerate(range(0, len(own), capacity)):
                        cut = own[a: a + capacity]
                        rows.append(lo + k)
                        piece.append(p)
                        start.append(a)
                        length.append(len(cut))
                        blobs.append(cut.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "piece", "start", "length", "ids"])
    return run


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids)``: each document's ids and an end id,
    cut only where they are more than ``capacity``; ``ids`` are little-endian
    unsigned 32-bit numbers.

    Null and blank texts are the end id alone. Ids may be null or repeat.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([kept.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return kept.mapInArrow(B.lean(_piece_batches(tokenizer_path, capacity)), schema)


# --- plan -------------------------------------------------------------------

class _Counts:
    """How many pieces of each length are left."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for size, count in histogram.items():
            self.n[size] = count

    def most(self, room: int) -> int:
        """Largest length of at most ``room`` (0: none)."""
        there = np.flatnonzero(self.n[: max(room, 0) + 1])
        return int(there[-1]) if len(there) else 0

    def smallest(self, k: int) -> int:
        """Sum of the k smallest pieces (too large if there are fewer)."""
        there = np.flatnonzero(self.n)
        took = total = 0
        for s in there[:k].tolist():
            m = min(k - took, int(self.n[s]))
            took, total = took + m, total + m * s
            if took == k:
                return total
        return 1 << 60

    def best_pair(self, room: int) -> tuple[int, int]:
        """Two lengths with the largest sum of at most ``room`` ((0, 0): none)."""
        sizes = np.flatnonzero(self.n[: max(room, 0) + 1])
        if not len(sizes):
            return 0, 0
        upto = np.zeros(room + 1, np.int64)
        upto[sizes] = sizes
        upto = np.maximum.accumulate(upto)
        twin = np.minimum(room - sizes, sizes)
        mate = np.where(twin > 0, upto[np.maximum(twin, 0)], 0)
        # A length can't pair with itself if it is there once.
        alone = (mate == sizes) & (self.n[sizes] < 2)
        mate[alone] = upto[sizes[alone] - 1]
        total = np.where(mate > 0, sizes + mate, 0)
        best = int(total.argmax())
        return (int(sizes[best]), int(mate[best])) if total[best] else (0, 0)


def dominance_reduction(left: _Counts, capacity: int) -> list[tuple[list[int], int]]:
    """Fix every set that dominates; ``left`` keeps the other pieces. The sets
    are (lengths, how often)."""
    fixed = []
    for size in np.flatnonzero(left.n)[::-1].tolist():
        while left.n[size]:
            left.n[size] -= 1
            room = capacity - size
            mate = left.most(room)
            if not mate:
                # Nothing fits beside it, nor beside its equals.
                many = int(left.n[size]) + 1
                left.n[size] = 0
                fixed.append(([size], many))
                break
            chosen = None
            if mate == room or left.smallest(2) > room:
                chosen = [mate]  # fills the sequence, or no two pieces fit
            elif left.smallest(3) > room:
                a, b = left.best_pair(room)
                if mate >= a + b:
                    chosen = [mate]  # no two pieces fill as much as one
                elif a + b == room and not _dearer_pair(left, a, b, room):
                    chosen = [a, b]
            left.n[size] += 1
            if chosen is None:
                break
            need = {s: [size, *chosen].count(s) for s in {size, *chosen}}
            many = min(int(left.n[s]) // k for s, k in need.items())
            if len(chosen) == 2:
                many = 1  # the other pairs change with each one taken
            for s, k in need.items():
                left.n[s] -= many * k
            fixed.append(([size, *chosen], many))
    return fixed


def _dearer_pair(left: _Counts, a: int, b: int, room: int) -> bool:
    """Whether another pair that fits has a larger smallest piece, or a larger
    largest one, so that (a, b) need not dominate it."""
    sizes = np.flatnonzero(left.n[: room + 1])
    inner = sizes[(sizes > b) & (sizes < a)]
    if not len(inner):
        return False
    # (x, y) with b < y <= x < a fits: neither piece of it is covered by b.
    y = int(inner[0])
    return y + y <= room if left.n[y] > 1 else len(inner) > 1 and y + int(inner[1]) <= room


def best_fit(left: _Counts, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over groups of equal pieces and of equal
    sequences: ([(length, pieces a sequence)], sequences)."""
    # room left -> [(contents, sequences)]
    groups: dict[int, list] = {}
    rooms: list[int] = []

    def put(room: int, contents: list, many: int) -> None:
        if many:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((contents, many))

    for size in np.flatnonzero(left.n)[::-1].tolist():
        count = int(left.n[size])
        while count:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                each = capacity // size
                put(capacity - each * size, [(size, each)], count // each)
                if count % each:
                    put(capacity - count % each * size, [(size, count % each)], 1)
                break
            room = rooms[at]
            contents, many = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            # Equal pieces go on filling the same sequence: it stays the best fit.
            each = room // size
            full = min(many, count // each)
            put(room - each * size, [*contents, (size, each)], full)
            rest, count = many - full, count - full * each
            if rest and count and count < each:
                put(room - count * size, [*contents, (size, count)], 1)
                rest, count = rest - 1, 0
            put(room, contents, rest)
    return [g for room in rooms for g in groups[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Segments (length, first rank, pieces a sequence, first sequence,
    offset), sorted; ranks of a length are dealt out in their order."""
    left = _Counts(histogram, capacity)
    made = []
    for sizes, many in dominance_reduction(left, capacity):
        made.append(([(s, sizes.count(s)) for s in dict.fromkeys(sizes)], many))
    made += best_fit(left, capacity)
    rank = np.zeros(capacity + 1, np.int64)
    out, sequence = [], 0
    for contents, many in made:
        offset = 0
        for size, each in contents:
            out.append((size, rank[size], each, sequence, offset))
            rank[size] += each * many
            offset += size * each
        sequence += many
    return np.array(sorted(out), np.int64).reshape(-1, 5)


# --- operator ---------------------------------------------------------------

def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to
    ``capacity``; sequences are gapless from offset 0 and never longer than
    ``capacity``. ``order`` makes the places of equal lengths repeatable."""
    spark = pieces.sparkSession
    keyed = written(pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(wide(spark))).cast("int")), "pieces")
    counts = written(keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "piece_counts")
    # At most one row for each length: capacity rows.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths {min(histogram)} to {max(histogram)}; the capacity is {capacity}")
    segments = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = (keyed.withColumn("_rank", F.row_number().over(inside)).join(first, ["length", "_bucket"])
              .select(*pieces.columns, (F.col("_first") + F.col("_rank") - 1).alias("_rank")))
    at = pieces.columns.index("length")
    shift = 44
    keys = (segments[:, 0] << shift) + segments[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            _, lo, each, sequence, offset = segments[i].T
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(sequence + (rank - lo) // each), pa.array(offset + (rank - lo) % each * length)],
                names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Pieces of all documents with their places: ``(id, piece, start,
    length, <keep>, sequence_id, offset)``.

    ``keep`` names columns computed from a piece's ``ids`` (a checksum, or the
    ids themselves). Null texts are the end id alone; repeated rows are packed
    as often as they come; other columns are ignored; an empty table gives an
    empty table.
    """
    pieces = tokenised_pieces(docs, tokenizer_path, capacity, id_col, text_col)
    keep = keep if keep is not None else {"ids": F.col("ids")}
    pieces = pieces.select("id", "piece", "start", "length", *[c.alias(n) for n, c in keep.items()])
    return pack(pieces, ["id", "piece", *keep], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)`` of packed pieces that kept their ids: at
    most ``capacity`` ids a group."""
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"),
                                              F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", "length", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
