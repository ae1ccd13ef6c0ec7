"""URL rules by a Bloom filter cascade, native expressions only.

A rule is a host and a path prefix with an action; it fits its host and all
subdomains where the url's path starts with the rule's path. The longest
fitting rule wins.

Every url has a few candidate keys (its host's suffixes at label borders,
times its path's prefixes of the lengths that rules have). Whether a key is
listed is answered by a cascade: level 0 encodes the listed keys, level 1 the
keys of the corpus that pass level 0 without being listed, level 2 the listed
keys that pass level 1, and so on until nothing passes wrongly. Over the key
universe it was built on (all candidate keys of the whole corpus) the answer
is exact. Level 0 is sized for about as many false positives as there are
listed keys, so the cascade grows with the rules, not with the corpus, and
the scan of the urls needs neither a join nor a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import written

#: Most listed keys of one cascade: its levels' bits are literals of the plan.
#: More keys make more cascades, by the keys' hash.
MAX_LISTED = 1_000_000
MAX_LEVELS = 40
#: Least bits of a level.
LEAST_BITS = 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEP = "\u0001"


# --- urls -------------------------------------------------------------------

def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one
    without ``://``."""
    before = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1))
    rest = F.substring(url, F.length(before) + 4, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Array of (size, host, path) of the keys that could fit a url."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.split(F.lit(",".join(map(str, path_lengths))), ",").cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(
        (F.length(h) + F.length(p)).alias("size"), h.alias("host"), p.alias("path")))))


def key_of(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(SEP), path)


# --- cascade ----------------------------------------------------------------

@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...]


def _places(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    """Bit numbers of a key (``bits`` is a power of two)."""
    h = F.xxhash64(F.lit(seed), key)
    a = h.bitwiseAND(F.lit((1 << 31) - 1))
    b = F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return [(a + b * i).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]


def passes(key: Column, level: Level) -> Column:
    """Whether a key passes one level."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    tests = []
    for p in _places(key, level.seed, level.bits, level.hashes):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        tests.append(F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return reduce(lambda x, y: x & y, tests)


def listed(key: Column, cascade: list[Level]) -> Column:
    """Exact membership for the keys of the universe."""
    out = F.lit(False)
    # Level 0 passes, then 1 doesn't: listed; 1 passes, then 2 doesn't: not; ...
    for depth, level in reversed(list(enumerate(cascade))):
        deeper = out if depth < len(cascade) - 1 else F.lit(depth % 2 == 0)
        out = F.when(passes(key, level), deeper).otherwise(F.lit(depth % 2 == 1))
    return out


def _level(keys: DataFrame, n: int, seed: int, per_key: float) -> Level:
    bits = 1 << max(int(LEAST_BITS).bit_length() - 1, math.ceil(math.log2(max(1.0, n * per_key))))
    hashes = max(1, min(16, round(per_key * math.log(2))))
    places = F.explode(F.array(*_places(F.col("key"), seed, bits, hashes)))
    rows = (keys.select(places.alias("p")).distinct()
            .groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b")))
    words = [0] * (bits // 64)
    for r in rows.toLocalIterator():  # at most bits / 64 rows, set by the number of keys
        words[r.w] = r.b
    return Level(seed, bits, hashes, tuple(words))


def build_cascade(keys: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell the listed ``keys(key)`` from all other keys of
    ``universe(key)``. No keys: no levels (nothing is listed)."""
    keys = written(keys.where(F.col("key").isNotNull()).distinct(), "listed_keys")
    n = keys.count()
    if n == 0:
        return []
    others = universe.join(keys, "key", "left_anti")
    total = max(universe.count(), 1)
    per_key = max(10.0, 1.44 * math.log2(max(total / n, 2)))
    inside, outside, cascade = keys, others, []
    for depth in range(MAX_LEVELS):
        cascade.append(_level(inside, n, depth + 1, per_key if depth == 0 else 4.0))
        # What passes wrongly is what the next level has to encode.
        wrong = written(outside.where(passes(F.col("key"), cascade[-1])), "wrong_keys")
        n = wrong.count()
        if n == 0:
            return cascade
        inside, outside = wrong, inside
    raise RuntimeError("the cascade did not end")


# --- operator ---------------------------------------------------------------

def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(action, host, path)`` rows as a DataFrame."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def _group(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("group"), key), F.lit(groups)).cast("int")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id",
          default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row per row of ``pages``.

    The rule is the longest that fits (host and path together; then the
    longer host), null if none, and the verdict its action (a key listed
    under both actions is allowed), else ``default``: a url that the cascade
    does not list. A rule's host is compared with A-Z lower-cased, as a url's;
    an action other than ``allow`` and ``block`` is an error; rules without a
    host or path column value are left out. Null urls and urls without ``://``
    have an empty host and path and fit no rule with a host. Ids may be null or
    repeat. Empty tables give an empty result, no rules the default for every
    page.

    Only listed keys that some url has are encoded, so a long rule list costs
    one join with the corpus's distinct keys. More than ``MAX_LISTED`` of them
    are dealt to several cascades, and the urls are read once for each.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).withColumn("host", F.translate("host", UPPER, LOWER))
    odd = rules.where(~F.coalesce(F.col("action").isin("allow", "block"), F.lit(False))).select("action").limit(1).collect()
    if odd:
        raise ValueError(f"a rule's action is allow or block, not {odd[0].action!r}")
    lengths = [r.n for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    host, path = host_and_path(F.col("_url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("_url")) \
        .select("id", host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("string")
    if not lengths:
        return urls.select("id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    urls = urls.withColumn("_keys", candidates(F.col("host"), F.col("path"), sorted(lengths)))
    keys = urls.select(F.explode("_keys").alias("k")).select(key_of(F.col("k.host"), F.col("k.path")).alias("key"))
    universe = written(keys.distinct(), "key_universe")
    asked = rules.select("action", key_of(F.col("host"), F.col("path")).alias("key")).distinct().join(universe, "key", "left_semi")
    asked = written(asked, "rules_in_use")
    most = asked.groupBy("action").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, math.ceil(most / MAX_LISTED))

    def fits(group: int) -> Column:
        mine = lambda df: df if groups == 1 else df.where(_group(F.col("key"), groups) == group)
        cascades = {a: build_cascade(mine(asked.where(F.col("action") == a).select("key")), mine(universe)) for a in ("allow", "block")}

        def is_listed(k: Column, action: str) -> Column:
            key = key_of(k["host"], k["path"])
            inside = listed(key, cascades[action]) if cascades[action] else F.lit(False)
            return inside if groups == 1 else (_group(key, groups) == group) & inside

        return F.transform(F.filter("_keys", lambda k: is_listed(k, "allow") | is_listed(k, "block")), lambda k: F.struct(
            k["size"].alias("size"), F.length(k["host"]).alias("host_size"), k["host"].alias("host"), k["path"].alias("path"),
            is_listed(k, "allow").alias("allow")))

    best = urls.withColumn("_best", F.array_max(fits(0)))
    for group in range(1, groups):  # a plan holds one group's literals
        best = written(best, "best_so_far").withColumn("_best", F.array_max(F.array_append(fits(group), F.col("_best"))))
    b = F.col("_best")
    action = F.when(b.isNull(), F.lit(default)).when(b["allow"], F.lit("allow")).otherwise(F.lit("block"))
    return best.select("id", "host", "path", F.concat(b["host"], b["path"]).alias("rule"), action.alias("verdict"))
