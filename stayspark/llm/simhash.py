"""SimHash near-duplicates by anchor-point covering.

Fingerprint: for every bit, whether more than half of the document's word
shingles have it set in their XXH64. Two documents are linked when their
fingerprints differ in at most ``max_bits`` bits; a component is what links
reach.

Search: the 64 bits are cut into ``blocks`` parts. Two fingerprints that
differ in at most ``max_bits`` bits differ in at most ``max_bits // blocks``
= t bits of some part. On each part, the anchors are the words of a covering
code: the perfect Hamming code on the part's first 15 bits (covering radius
1), with the other bits free. Every fingerprint lives at its nearest anchor
and is replicated to every anchor within covering radius plus t that may be
the home of a fingerprint at most t bits away; homes and visitors are
compared anchor by anchor, exactly, on all 64 bits. Nothing is missed.

Only distinct fingerprints are searched, so copies cost nothing. An anchor
with many homes is cut into several cells by its homes' hash; visitors go to
each cell. Inside a cell only a spanning set of links leaves the task, never
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import free_name, small_enough, wide, written
from .components import components
from .textbytes import lean

#: Fixed values of the fingerprint.
SEED = 42
BITS = 64
#: Positions of the Hamming code.
CODED = 15
#: Homes of one anchor that are compared in one cell.
CELL = 2048
#: Pairs compared at once in a task.
PAIRS = 1 << 21
#: Hot anchors whose table may be broadcast.
HOT_ROWS = 200_000
#: Fingerprints of one component that are joined in one place.
LARGE = 200_000
#: Rows to drop (an id and a hash each) whose list may be broadcast.
LISTED_ROWS = 300_000


# --- fingerprints -----------------------------------------------------------

def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned fingerprint of a whole text; no words (or null): 0."""
    # bytes.lower() changes A-Z alone, bytes.split() cuts at x20 and x09-x0D.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.cumsum(size + 1) - size - 1
    end = (start + size)[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(start[:n].tolist(), end)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, 4096):
        cut = h[lo: lo + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(cut, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprint_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, b.num_rows)
            cols = b.columns[:-1] + [pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1] + ["fingerprint"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id, text_key, fingerprint)``, one row per row of ``docs``;
    fingerprint is a long that holds the 64 bits, text_key a hash of the
    text."""
    text = F.col(text_col).cast("string")
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    schema = T.StructType([*kept.schema.fields[:2], T.StructField("fingerprint", T.LongType())])
    return kept.mapInArrow(lean(_fingerprint_batches(words)), schema)


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- anchors ----------------------------------------------------------------

def _parts(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each part."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _code_tables(t: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nearest code word of each 15-bit word, and for each j <= t the homes
    that a word's neighbours at j bits have (one column per way, with -1)."""
    words = np.arange(1 << CODED, dtype=np.int64)
    syndrome = np.zeros_like(words)
    for i in range(CODED):
        syndrome ^= ((words >> i) & 1) * (i + 1)
    nearest = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    ways = []
    for j in range(t + 1):
        cols = []
        for bits in combinations(range(CODED), j):
            mask = sum(1 << b for b in bits)
            cols.append(nearest[words ^ mask])
        table = np.sort(np.stack(cols, axis=1), axis=1)
        table[:, 1:][table[:, 1:] == table[:, :-1]] = -1
        keep = np.sort(table, axis=1)[:, ::-1]
        ways.append(keep[:, : int((keep >= 0).sum(axis=1).max())])
    return nearest, ways


def replicas(fp: np.ndarray, blocks: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fp, is home) of every place a fingerprint goes to.

    Ways with j coded bits changed and up to t - j free bits changed; the home
    itself comes once, marked."""
    nearest, ways = _code_tables(t)
    out = []
    for k, (first, bits) in enumerate(_parts(blocks)):
        part = (fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        part = part.astype(np.int64)
        coded, free = part & ((1 << CODED) - 1), part >> CODED
        at = np.int64(k) << 40
        home = at | (free << CODED) | nearest[coded]
        index = np.arange(len(fp))
        out.append((home, index, np.ones(len(fp), bool)))
        seen_near = [home]
        for j in range(t, -1, -1):
            near = ways[j][coded]
            # A home reached by fewer coded changes is reached with more free changes as well.
            for f in range(t - j + 1):
                for flip in combinations(range(bits - CODED), f):
                    mask = sum(1 << b for b in flip)
                    a = at | ((free ^ mask)[:, None] << CODED) | near
                    ok = (near >= 0) & (a != home[:, None])
                    row, col = np.nonzero(ok)
                    out.append((a[row, col], index[row], np.zeros(len(row), bool)))
        del seen_near
    anchor = np.concatenate([o[0] for o in out])
    index = np.concatenate([o[1] for o in out])
    home = np.concatenate([o[2] for o in out])
    # One row per (anchor, fingerprint).
    order = np.lexsort((~home, index, anchor))
    anchor, index, home = anchor[order], index[order], home[order]
    first = np.ones(len(anchor), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (index[1:] != index[:-1])
    return anchor[first], index[first], home[first]


def _replica_batches(blocks: int, t: int, homes_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fp), 8192):
                cut = fp[lo: lo + 8192]
                a, i, h = replicas(cut, blocks, t)
                if homes_only:
                    a, i, h = a[h], i[h], h[h]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(cut[i].view(np.int64)), pa.array(h)], names=["anchor", "fp", "home"])
    return run


# --- comparison -------------------------------------------------------------

def _local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, least node) of the components of the links u-v."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _cell_links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs (home, member of its cell) at most
    ``max_bits`` apart; rows sorted by cell."""
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    group = np.cumsum(np.r_[False, cell[1:] != cell[:-1]])
    homes = np.flatnonzero(home)
    n_homes = np.bincount(group[homes], minlength=len(start))
    first_home = np.cumsum(n_homes) - n_homes
    width = n_homes[group]
    found_u, found_v = np.empty(0, np.uint64), np.empty(0, np.uint64)
    edge = np.cumsum(width)
    lo = 0
    while lo < len(cell):
        hi = int(np.searchsorted(edge, (edge[lo - 1] if lo else 0) + PAIRS, side="right"))
        hi = max(hi, lo + 1)
        w = width[lo:hi]
        left = np.repeat(np.arange(lo, hi), w)
        step = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)
        right = homes[first_home[group[left]] + step] if len(left) else left
        x, y = fp[left], fp[right]
        near = (np.bitwise_count(x ^ y) <= max_bits) & (x != y)
        if near.any():
            u = np.concatenate([found_u, np.maximum(x[near], y[near])])
            v = np.concatenate([found_v, np.minimum(x[near], y[near])])
            found_u, found_v = _local_roots(u, v)
        lo = hi
    return found_u, found_v


def _link_batches(max_bits: int):
    """Rows arrive sorted by cell, homes first. A batch's rows are compared
    with the homes of their cell as they come; of a cell that goes on in the
    next batch only its homes (about ``CELL`` at most) are kept, however many
    visitors it has. Links found are thinned per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if b.num_rows == 0:
                continue
            c = b.column(0).to_numpy(zero_copy_only=False)
            f = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            h = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if kept is not None and len(kept[0]) and kept[0][0] == c[0]:
                c, f, h = (np.concatenate([x, y]) for x, y in zip(kept, (c, f, h)))
            u, v = _cell_links(c, f, h, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
            last = (c == c[-1]) & h
            kept = (c[last], f[last], h[last])
    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = 4, blocks: int = 3) -> DataFrame:
    """``(u, v)``: links that span the components of the distinct
    fingerprints (column ``fp``) under "at most max_bits differing bits"."""
    spark = distinct.sparkSession
    t = max_bits // blocks
    schema = "anchor long, fp long, home boolean"
    homes = distinct.mapInArrow(_replica_batches(blocks, t, True), schema)
    hot = written(homes.groupBy("anchor").count().where(F.col("count") > CELL)
                  .select("anchor", F.ceil(F.col("count") / CELL).cast("int").alias("cells")), "hot_anchors")
    rows = distinct.mapInArrow(lean(_replica_batches(blocks, t, False)), schema)
    if not hot.isEmpty():
        hot = F.broadcast(hot) if small_enough(hot, HOT_ROWS) else hot
        rows = rows.join(hot, "anchor", "left")
        all_cells = F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)
        own = F.pmod(F.xxhash64("fp"), F.coalesce("cells", F.lit(1))).cast("int")
        # A home lives in one cell and visits the anchor's other cells.
        rows = (rows.withColumn("c", F.explode(all_cells)).withColumn("home", F.col("home") & (F.col("c") == own))
                .withColumn("cell", F.col("anchor") + F.shiftleft(F.col("c").cast("long"), 44)))
    else:
        rows = rows.withColumnRenamed("anchor", "cell")
    rows = rows.select("cell", "fp", "home").repartition(wide(spark), "cell").sortWithinPartitions("cell", F.desc("home"))
    return rows.mapInArrow(lean(_link_batches(max_bits)), "u long, v long").distinct()


# --- operator ---------------------------------------------------------------

def _classes(prints: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """``(fp, root)`` of each distinct fingerprint; an unlinked one is its
    own root."""
    distinct = written(prints.select(F.col("fingerprint").alias("fp")).distinct(), "distinct_prints")
    roots = components(fingerprint_links(distinct, max_bits, blocks))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _of_component(classes: DataFrame, least: DataFrame) -> DataFrame:
    """``classes`` with their component's id. A large component is a key that
    many fingerprints share: those (at most one for each ``LARGE`` fingerprints) are
    dealt out by salt, the others are joined as they are."""
    salts = F.when(F.col("members") > LARGE, F.ceil(F.col("members") / LARGE)).otherwise(1).cast("int")
    if least.where(F.col("members") > LARGE).isEmpty():
        return classes.join(least.drop("members"), "root")
    large = least.where(F.col("members") > LARGE).select("root", salts.alias("salts"))
    large = F.broadcast(large) if small_enough(large, HOT_ROWS) else large
    salt = F.pmod(F.xxhash64("fp", F.lit(3)), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = classes.join(large, "root", "left").withColumn("salt", salt)
    ids = least.select("root", "component_id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return dealt.join(ids, ["root", "salt"]).drop("salt", "salts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                    max_bits: int = 4, blocks: int = 3) -> DataFrame:
    """``(id, fingerprint, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id that links reach (ids of equal
    fingerprints are linked). Null or blank texts have fingerprint zero and
    are linked like any other. Repeated rows give repeated results. A null id
    is a component's id only where the component has no other. An empty
    table gives an empty table; other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    own = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("least_id"))
    classes = _classes(prints, max_bits, blocks).join(own, "fp")
    least = written(classes.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members")), "components")
    of = written(_of_component(classes, least).select("fp", "component_id"), "print_components")
    return prints.join(of, prints.fingerprint == of.fp).select("id", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                         max_bits: int = 4, blocks: int = 3) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: the one with
    the smallest id (null ids last; of rows with that id, the one with the
    least text hash; of equal rows, one)."""
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = _classes(prints, max_bits, blocks)
    of_root = prints.groupBy("fingerprint").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("row"))
    keep = (of_root.join(classes, F.col("fingerprint") == F.col("fp")).groupBy("root").agg(F.min("row").alias("row"))
            .select(F.col("row.id").alias("_keep_id"), F.col("row.text_key").alias("_keep_key")))
    keep = written(keep, "kept_rows")
    rows = prints.groupBy("id", "text_key").agg(F.count("*").alias("n"))
    chosen = F.col("id").eqNullSafe(F.col("_keep_id")) & (F.col("text_key") == F.col("_keep_key"))
    drop = written(rows.join(keep, chosen, "left_anti").select("id", "text_key"), "dropped_rows")
    twice = written(rows.where("n > 1").join(keep, chosen, "left_semi").select("id", "text_key"), "repeated_rows")
    # names that docs doesn't have
    key, some_id, some_key = (free_name(docs, n) for n in ("_text_key", "_some_id", "_some_key"))
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))

    def only(df: DataFrame, some: DataFrame, how: str) -> DataFrame:
        """A short list goes to every task; a long one is joined by shuffle."""
        some = some.select(F.col("id").alias(some_id), F.col("text_key").alias(some_key))
        some = F.broadcast(some) if small_enough(some, LISTED_ROWS) else some
        return df.join(some, df[id_col].eqNullSafe(F.col(some_id)) & (df[key] == F.col(some_key)), how)

    kept = only(keyed, drop, "left_anti")
    if not twice.isEmpty():
        kept = only(kept, twice, "left_anti").unionByName(only(kept, twice, "left_semi").dropDuplicates([id_col, key]))
    return kept.drop(key)
