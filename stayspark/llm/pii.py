"""Personal data spans by weak supervision, native expressions only.

Base spans are what four fixed patterns and their checks find; they always
stay. The method adds spans: wider patterns propose candidates (a phone or
card number that a neighbouring number hides from the base pattern, written
out addresses, IPv6), and labelers vote on every candidate: pattern, shape
and checksum, gazetteers, words in the context, and the characters around.
Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern is personal data; a
logistic span classifier is trained on those and decides. Only the counts of
the possible vote patterns (a fixed number) come to the driver.

Every text is read once. Positions come from the lengths of what a pattern
leaves between its matches; patterns are written so that no text, however
long, takes more than linear time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, small_enough, written

# --- fixed values: kinds in their order, patterns, word lists ---
KINDS = ("email", "ip", "card", "phone")
#: A match starts where its first run of characters starts, or where the last
#: match ended: the leftmost matches of the plain patterns, without retries
#: inside a run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[a-z0-9-]{2,24}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[ ./_-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Cheap tests that a text with a match passes.
BASE_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
WIDE_HINT = {"email": r"(?i)[\[(] ?at ?[\])]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[ ./_-]?[0-9]{4}",
             "phone": r"[0-9]{3}[ .-][0-9]{4}"}
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"
GAZETTEER = {
    "email": r"(?i)[. \])](com|net|org|edu|gov|info|biz|io|eu|uk|us|de|fr|es|it|nl|ch|at|be|br|mx|ca|au|in|jp|cn|ru)$",
    "ip": r"^(?!0+\.)(?!255\.)[0-9A-Fa-f]",
    "card": r"^(3[0-9]|4|5[0-9]|6|2[2-7])",
    "phone": r"^(\+(1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])|\(?[2-9])",
}
CONTEXT = {
    "email": r"(?i)(mail|contact|kontakt|correo|courriel|write|escrib)",
    "ip": r"(?i)(\bip\b|address|adresse|host|server|login|direcci)",
    "card": r"(?i)(card|karte|tarjeta|carte|visa|master|amex|pay|zahl|pago)",
    "phone": r"(?i)(phone|tel|call|fax|mobil|handy|llam|appel|cell|sms|whatsapp)",
}
AGAINST = r"(?i)(version|isbn|issn|serial|order|invoice|figure|page|doi|hash|commit|sha)[^\n]{0,12}$"
# --- end of fixed values ---

CONTEXT_CHARS = 40
#: Spans that the classifier gives at least this probability are added.
LEAST = 0.8
#: How many pseudo-counts, as a share of a kind's candidates, hold a labeler's reliability to its first guess.
PRIOR_SHARE = 0.5
#: First guesses of P(against, abstains, for), of what isn't personal data and of what is.
FIRST_GUESS = {
    "pattern": [[0.01, 0.94, 0.05], [0.01, 0.29, 0.70]],
    "check": [[0.75, 0.05, 0.20], [0.01, 0.04, 0.95]],
    "gazetteer": [[0.50, 0.05, 0.45], [0.10, 0.05, 0.85]],
    "context": [[0.30, 0.67, 0.03], [0.03, 0.67, 0.30]],
    "around": [[0.50, 0.02, 0.48], [0.08, 0.02, 0.90]],
}
ROUNDS = 40
#: Rows of spans that may be broadcast.
BROADCAST_ROWS = 100_000


# --- candidates ---------------------------------------------------------------

def _found(text: Column, pattern: str, hint: str, kind: int, base: bool) -> Column:
    """Array of (kind, base, gap, value, before, after) of a pattern's
    matches; gap is the length of what stands before, since the last match."""
    empty = F.array().cast("array<struct<kind:int,base:boolean,gap:int,value:string,before:string,after:string>>")
    rest = F.split(text, pattern, -1)

    def one(between: Column, pair: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.length(between).alias("gap"), pair["v"].alias("value"),
                        F.right(between, F.lit(CONTEXT_CHARS)).alias("before"), F.left(pair["next"], F.lit(1)).alias("after"))

    # Match i stands between the parts i and i + 1 of the text.
    after = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.slice(rest, 2, F.size(rest)),
                       lambda v, n: F.struct(v.alias("v"), n.alias("next")))
    got = F.zip_with(F.slice(rest, 1, F.size(rest) - 1), after, one)
    is_there = F.contains(text, F.lit(hint)) if hint == "@" else F.regexp_like(text, F.lit(hint))
    return F.when(is_there, got).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda s, i: s + _luhn_digit(digits, i))
    return total % 10 == 0


def _luhn_digit(digits: Column, i: Column) -> Column:
    """Digit i from the right, doubled at even i (nine taken off if over 9)."""
    d = F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
    twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.when(i % 2 == 0, twice).otherwise(d)


def _by_kind(cases: dict[str, Column], default) -> Column:
    out = F.lit(default)
    for name, c in cases.items():
        out = F.when(F.col("kind") == KINDS.index(name), c).otherwise(out)
    return out


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(row, id, text_key)``, one for each row of ``docs``, and the spans
    ``(row, kind, base, start, end, value, before, after)``: those base
    matches that pass their check, and wider candidates that overlap none of
    them. Both are read from one stored table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = [_found(F.col("_t"), BASE[k], BASE_HINT[k], i, True) for i, k in enumerate(KINDS)]
    found += [_found(F.col("_t"), WIDE[k], WIDE_HINT[k], i, False) for i, k in enumerate(KINDS)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), text.alias("_t"))
    rows = written(rows.select("row", "id", "text_key", F.concat(*found).alias("found")), "pii_candidates")
    each = rows.where(F.size("found") > 0).select("row", F.posexplode("found").alias("pos", "f")).select("row", "pos", "f.*")
    upto = Window.partitionBy("row", "kind", "base").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto))
    each = each.withColumn("start", F.col("end") - F.length("value"))
    digits = F.length(_digits(F.col("value")))
    passes = _by_kind({"email": F.lit(True), "ip": F.regexp_like("value", F.lit(IP_PARTS)),
                       "card": digits.between(14, 19) & luhn(_digits(F.when(digits.between(14, 19), F.col("value")).otherwise(""))),
                       "phone": digits.between(10, 15)}, False)
    each = each.where(~F.col("base") | passes)
    ahead = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # From the end: a frame that runs to the end of its rows is summed anew for each of them.
    behind = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("_reach", F.max(F.when(F.col("base"), F.col("end"))).over(ahead)) \
        .withColumn("_next", F.min(F.when(F.col("base"), F.col("start"))).over(behind))
    free = (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("_next") >= F.col("end"), F.lit(True)))
    spans = each.where(F.col("base") | free)
    return rows.select("row", "id", "text_key"), spans.select("row", "kind", "base", "start", "end", "value", "before", "after")


# --- labelers -----------------------------------------------------------------

LABELERS = ("pattern", "check", "gazetteer", "context", "around")


def votes(spans: DataFrame) -> DataFrame:
    """Adds a column for each labeler: 1 for, -1 against, 0 abstains."""
    value, digits = F.col("value"), _digits(F.col("value"))
    n = F.length(digits)

    def sign(yes: Column) -> Column:
        return F.when(yes, 1).otherwise(-1)

    check = _by_kind({"email": sign(F.length(value) <= 254), "ip": sign(F.length(value) <= 39),
                      "card": sign(n.between(14, 19) & luhn(F.when(n.between(14, 19), digits).otherwise(F.lit("")))),
                      "phone": sign(n.between(10, 15) & ~F.regexp_like(digits, F.lit(r"^(.)\1+$")))}, 0)
    known = _by_kind({k: sign(F.regexp_like(value, F.lit(p))) for k, p in GAZETTEER.items()}, 0)
    near = _by_kind({k: F.regexp_like("before", F.lit(p)) for k, p in CONTEXT.items()}, False)
    context = F.when(F.regexp_like("before", F.lit(AGAINST)), -1).when(near, 1).otherwise(0)
    glued = F.regexp_like("before", F.lit(r"""[\p{L}0-9_=/"#-]$""")) | F.regexp_like("after", F.lit(r"""[\p{L}0-9_="/]"""))
    return (spans.withColumn("v_pattern", F.when(F.col("base"), 1).otherwise(0)).withColumn("v_check", check)
            .withColumn("v_gazetteer", known).withColumn("v_context", context).withColumn("v_around", F.when(glued, -1).otherwise(1)))


@dataclass(frozen=True)
class Reliability:
    """P(vote | class) of each kind and labeler, and each kind's share."""
    table: np.ndarray   # kind, labeler, class, vote + 1
    share: np.ndarray   # kind


def estimate(kind: np.ndarray, vote: np.ndarray, n: np.ndarray) -> tuple[Reliability, np.ndarray]:
    """Expectation-maximisation over vote patterns with their counts:
    reliabilities, and each pattern's probability of personal data."""
    k, m = len(KINDS), len(LABELERS)
    guess = np.array([FIRST_GUESS[name] for name in LABELERS])
    table, share = np.repeat(guess[None], k, axis=0), np.full(k, 0.5)
    p = np.full(len(n), 0.5)
    for _ in range(ROUNDS):
        like = np.ones((len(n), 2))
        for c in (0, 1):
            for j in range(m):
                like[:, c] *= table[kind, j, c, vote[:, j] + 1]
        yes, no = share[kind] * like[:, 1], (1 - share[kind]) * like[:, 0]
        p = yes / np.maximum(yes + no, 1e-300)
        for a in range(k):
            own = kind == a
            total = n[own].sum()
            held = PRIOR_SHARE * total + 2
            share[a] = ((n * p)[own].sum() + 1) / (total + 2)
            for j in range(m):
                for c, weight in ((0, 1 - p), (1, p)):
                    seen = np.bincount(vote[own, j] + 1, (n * weight)[own], 3)
                    table[a, j, c] = (seen + held * guess[j, c]) / (seen.sum() + held)
    return Reliability(table, share), p


def _indicators(kind: np.ndarray, vote: np.ndarray) -> np.ndarray:
    """Features of the span classifier: kind, and each labeler's yes and no."""
    cols = [kind == a for a in range(len(KINDS))]
    for j in range(len(LABELERS)):
        cols += [vote[:, j] > 0, vote[:, j] < 0]
    return np.stack(cols, axis=1).astype(float)


def train(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weights of the logistic span classifier, by Newton steps on the
    patterns' probabilities, each pattern weighted by the root of its count."""
    x = _indicators(kind, vote)
    w = np.zeros(x.shape[1])
    weight = np.sqrt(n)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - q)) - 0.1 * w
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    return w


def _probability(w: np.ndarray) -> Column:
    terms = [F.when(F.col("kind") == a, float(w[a])).otherwise(0.0) for a in range(len(KINDS))]
    for j, name in enumerate(LABELERS):
        yes, no = w[len(KINDS) + 2 * j: len(KINDS) + 2 * j + 2]
        terms.append(F.when(F.col(f"v_{name}") > 0, float(yes)).when(F.col(f"v_{name}") < 0, float(no)).otherwise(0.0))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


# --- operator -----------------------------------------------------------------

def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(row, id, text_key)``, one for each row of ``docs``, and ``(row, kind,
    start, end, base, probability)``: all base spans and the added ones
    (kind by its place in ``KINDS``; code points, end exclusive).

    Null texts are empty and have no spans; repeated rows have their spans
    each; other columns are ignored; empty tables give empty ones.
    """
    rows, spans = candidates(docs, id_col, text_col)
    voted = written(votes(spans).drop("value", "before", "after"), "pii_votes")
    cols = [f"v_{name}" for name in LABELERS]
    # At most kinds times 3 ** labelers rows.
    patterns = voted.groupBy("kind", *cols).agg(F.count("*").alias("n")).collect()
    if not patterns:
        return rows, voted.select("row", "kind", "start", "end", "base", F.lit(1.0).alias("probability"))
    patterns.sort()
    kind = np.array([r.kind for r in patterns])
    vote = np.array([[r[c] for c in cols] for r in patterns])
    n = np.array([r.n for r in patterns], float)
    _, p = estimate(kind, vote, n)
    scored = voted.withColumn("probability", _probability(train(kind, vote, n, p)))
    return rows, scored.where(F.col("base") | (F.col("probability") >= least)).select("row", "kind", "start", "end", "base", "probability")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``(id, text_key, <kind counts of base spans>, base, spans)``, one row
    per row of ``docs``: ``kind:start:end`` by start, then kind, joined by
    commas, of the base spans and of all spans."""
    rows, spans = find_spans(docs, id_col, text_col, least)
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base")))
    per = spans.groupBy("row").agg(listed.alias("s"))

    def joined(s: Column) -> Column:
        name = F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
        return F.concat_ws(":", name, s["start"].cast("string"), s["end"].cast("string"))

    s = F.coalesce("s", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>"))
    out = rows.join(per, "row", "left").withColumn("s", s)
    base = F.filter("s", lambda x: x["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == kind))).cast("long")

    counts = [count(a).alias(f"n_{k}") for a, k in enumerate(KINDS)]
    return out.select("id", "text_key", *counts, F.array_join(F.transform(base, joined), ",").alias("base"),
                      F.array_join(F.transform("s", joined), ",").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST,
           size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` (all rows and columns) with every span replaced by its kind in
    brackets; spans that overlap become one, named by the first. ``size_col``,
    where there is one, is set to the new text's length in code points."""
    rows, spans = find_spans(docs, id_col, text_col, least)
    before = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int"))
    upto = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = (spans.withColumn("_run", F.sum("_new").over(upto)).groupBy("row", "_run")
              .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kind", "end")).alias("first")))
    per = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("first.kind").alias("kind")))).alias("_spans"))
    # Rows with equal ids and texts have equal spans.
    found = (rows.join(per, "row").groupBy(F.col("id").alias("_span_id"), F.col("text_key").alias("_span_key"))
             .agg(F.min("_spans").alias("_spans")))
    found = written(found, "pii_spans")
    # names that docs doesn't have
    key, of_id, of_key, cuts = (free_name(docs, n) for n in ("_text_key", "_span_id", "_span_key", "_spans"))
    found = found.toDF(of_id, of_key, cuts)
    found = F.broadcast(found) if small_enough(found, BROADCAST_ROWS) else found
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    joined = keyed.join(found, keyed[id_col].eqNullSafe(F.col(of_id)) & (keyed[key] == F.col(of_key)), "left")
    tag = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(text_col).cast("string")
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(cuts, state, lambda a, s: F.struct(
        F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                 F.element_at(tag, s["kind"] + 1)).alias("out"), s["end"].alias("at")))
    new = F.when(F.col(cuts).isNull(), t).otherwise(F.concat(done["out"], F.substring(t, (done["at"] + 1).cast("int"), F.length(t))))
    out = {text_col: new}
    if size_col in docs.columns:
        out[size_col] = F.when(F.col(cuts).isNull(), F.col(size_col)).otherwise(F.length(new).cast(docs.schema[size_col].dataType))
    return joined.withColumns(out).select(*docs.columns)
