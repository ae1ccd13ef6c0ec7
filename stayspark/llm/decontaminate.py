"""Benchmark decontamination over a positional inverted index, native
expressions only.

The index is a stored table of postings (row, position, term) of every
training token whose term occurs in the benchmark, written in one pass over
the texts; a sentinel posting ends every row and carries its id and number of
words. A phrase is found from its rarest term (by the corpus's counts): the
postings of that term give start positions, those are intersected with the
offset-adjusted postings of the second rarest term, and what is left is
checked against the postings of every other term. Only rows that still have a
candidate are read for the last step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, small_enough, written

#: Words of a window.
WINDOW = 13
#: Rows of a side that may be broadcast (a few long numbers each).
BROADCAST_ROWS = 300_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII other than digits and (lower-cased) letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A term that no text has; it ends each row of the index.
END = "\u0000"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _cut(text: Column) -> Column:
    """Text cut at what stands between words; the first and last part may be
    empty."""
    return F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN, -1)


def words(text: Column) -> Column:
    """Array of the words of a text; none for null."""
    return F.filter(_cut(text), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the rows are few; else Spark joins by shuffle."""
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


# --- index ------------------------------------------------------------------

@dataclass(frozen=True)
class Index:
    """``terms(term, term_id, n)``: the vocabulary with its corpus counts;
    ``postings(row, pos, term_id, n_words)``; ``rows(row, id, text_key,
    n_words)``: one for each row of the documents."""
    terms: DataFrame
    postings: DataFrame
    rows: DataFrame


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index the postings of the terms in ``vocabulary(term)``.

    Rows with a null or wordless text have no postings but their sentinel;
    repeated rows are rows of their own.
    """
    terms = vocabulary.where("term <> ''").select("term").distinct()
    end = terms.sparkSession.createDataFrame([(END,)], "term string")
    terms = written(terms.unionByName(end).withColumn("term_id", F.when(F.col("term") == END, 0).otherwise(F.monotonically_increasing_id() + 1)), "terms")
    text = F.col(text_col).cast("string")
    parts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"),
                        _cut(text).alias("parts"))
    lead, trail = (F.col("parts")[0] == "").cast("int"), (F.element_at("parts", -1) == "").cast("int")
    parts = parts.select("row", "id", "text_key", F.array_append("parts", END).alias("parts"), lead.alias("lead"),
                         F.greatest(F.size("parts") - lead - trail, F.lit(0)).alias("n_words"))
    tokens = parts.select("row", "id", "text_key", "lead", "n_words", F.posexplode("parts").alias("pos", "term"))
    found = (tokens.join(_small(terms), "term")
             .select("row", (F.col("pos") - F.col("lead")).alias("pos"), "term_id", "n_words",
                     *[F.when(F.col("term_id") == 0, F.col(c)).alias(c) for c in ("id", "text_key")]))
    stored = written(found, "postings")
    postings = stored.where("term_id > 0").select("row", "pos", "term_id", "n_words")
    counts = postings.groupBy("term_id").agg(F.count("*").alias("n"))
    terms = written(terms.where("term_id > 0").join(counts, "term_id", "left").select("term", "term_id", F.coalesce("n", F.lit(0)).alias("n")), "term_counts")
    return Index(terms, postings, stored.where("term_id = 0").select("row", "id", "text_key", "n_words"))


# --- phrases ----------------------------------------------------------------

def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(window_id, words)``, the distinct windows of the items, and
    ``(window_id, item_id)``. An item of fewer words, but not none, is one
    window."""
    cut = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col).cast("string")).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    each = cut.where(n > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    found = written(each.select("words").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    return found, written(each.join(found, "words").select("window_id", "item_id").distinct(), "window_items")


def _window_terms(index: Index, found: DataFrame) -> DataFrame:
    """``(window_id, size, offset, term_id, rank)`` of windows whose terms
    all occur, rarest first."""
    terms = found.select("window_id", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term")).join(_small(index.terms), "term")
    order = Window.partitionBy("window_id").orderBy("n", "offset")
    whole = Window.partitionBy("window_id")
    terms = (terms.withColumn("rank", F.row_number().over(order)).withColumn("least", F.min("n").over(whole))
             .withColumn("known", F.count("*").over(whole)))
    return written(terms.where("least > 0 and known = size").select("window_id", "size", "offset", "term_id", "rank"), "window_terms")


def phrase_matches(index: Index, found: DataFrame) -> DataFrame:
    """``(row, start, size, window_id)``: every occurrence of every window."""
    terms = _window_terms(index, found)

    def at(rank: int) -> DataFrame:
        own = terms.where(F.col("rank") == rank).select("window_id", "size", "offset", "term_id")
        hits = index.postings.join(_small(own), "term_id")
        return (hits.select("row", (F.col("pos") - F.col("offset")).alias("start"), "size", "window_id", "n_words")
                .where("start >= 0 and start + size <= n_words").drop("n_words"))

    first = written(at(1), "phrase_candidates")
    second = at(2)
    key = ["row", "start", "window_id"]
    rows = first.select("row").distinct()
    second = second.join(_small(rows), "row", "left_semi") if small_enough(rows, BROADCAST_ROWS) else second
    # A window of one word has no second rarest term.
    pairs = written(first.where("size = 1").unionByName(
        first.where("size > 1").join(second.select(key), key, "left_semi")), "phrase_pairs")
    short = pairs.where("size <= 2")
    long = pairs.where("size > 2")
    rest = terms.where("rank > 2").select("window_id", "offset", "term_id")
    want = long.join(_small(rest), "window_id").select(*key, "size", (F.col("start") + F.col("offset")).alias("pos"), "term_id")
    near = index.postings.select("row", "pos", "term_id").join(_small(long.select("row").distinct()), "row", "left_semi")
    whole = (want.join(near, ["row", "pos", "term_id"]).groupBy(*key, "size").agg(F.count("*").alias("n"))
             .where("n = size - 2").select("row", "start", "size", "window_id"))
    return short.select("row", "start", "size", "window_id").unionByName(whole)


def proximity_matches(index: Index, found: DataFrame, slop: int) -> DataFrame:
    """``(row, pos, window_id)``: places of a window's rarest term around
    which all its distinct terms occur, in any order, at most
    ``size - 1 + slop`` words away."""
    terms = _window_terms(index, found)
    least = terms.where("rank = 1").select("window_id", "term_id", "size")
    distinct = terms.select("window_id", "term_id").distinct()
    n = distinct.groupBy("window_id").agg(F.count("*").alias("n_terms"))
    centers = written(index.postings.join(_small(least), "term_id").select("row", F.col("pos").alias("center"), "window_id", "size"), "centers")
    near = index.postings.select("row", "pos", "term_id").join(_small(centers.select("row").distinct()), "row", "left_semi")
    want = centers.join(distinct, "window_id")
    return (want.join(near, ["row", "term_id"]).where(F.abs(F.col("pos") - F.col("center")) <= F.col("size") - 1 + slop)
            .groupBy("row", "center", "window_id").agg(F.count_distinct("term_id").alias("have")).join(n, "window_id")
            .where("have = n_terms").select("row", F.col("center").alias("pos"), "window_id"))


# --- operator ---------------------------------------------------------------

def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, one_in: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, text_key, n_words, n_hit, n_items, items, contaminated)``, one
    row per row of ``docs``.

    A word is hit inside any occurrence of a window. ``items`` are the ids, as
    sorted strings, of the items with occurring windows (null ids are left
    out). Contaminated: a word is hit, and at least one in ``one_in``.
    Null and wordless texts have no words; repeated rows and items change
    nothing for others; empty tables give no hits, or no rows.
    """
    found, of_item = windows(items, size, item_col, item_text_col)
    index = build_index(docs, found.select(F.explode("words").alias("term")), id_col, text_col)
    hits = written(phrase_matches(index, found), "phrase_hits")
    # Words covered: what each occurrence adds beyond the ends before it.
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    reach = F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = (spans.select("row", F.greatest(F.col("end") - reach, F.lit(0)).alias("new"))
               .groupBy("row").agg(F.sum("new").alias("n_hit")))
    named = (hits.select("row", "window_id").distinct().join(_small(of_item), "window_id").where("item_id is not null")
             .groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    out = index.rows.join(covered, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("id", "text_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                      F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
                      ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, one_in: int = 20, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that aren't contaminated."""
    bad = contamination(docs, items, size, one_in, id_col, text_col).where("contaminated").select("id", "text_key").distinct()
    # names that docs doesn't have
    key, bad_id, bad_key = (free_name(docs, n) for n in ("_text_key", "_bad_id", "_bad_key"))
    bad = _small(written(bad, "contaminated").toDF(bad_id, bad_key))
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    same = keyed[id_col].eqNullSafe(F.col(bad_id)) & (keyed[key] == F.col(bad_key))
    return keyed.join(bad, same, "left_anti").drop(key)
