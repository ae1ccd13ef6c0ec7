"""The registered queries of this subpackage, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (arc_warc, decontaminate, license_scan, packing, pii, quality, simhash, suffix_dedup, topk, toxicity, url_filter, va_clusters,
               word_runs)
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _scored(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, train_on=~held_out(F.col("doc_id")))
    return _scored(toxicity.score(docs, model), 0.5)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(),
                                 keep={"ids_crc32": F.crc32("ids")})
    return out.withColumnRenamed("id", "doc_id")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE["op3_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT r, size, i AS start, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, g.size, start, item_id FROM grams g JOIN win USING (phrase) WHERE g.size = win.size),
covered AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(start, start + size)) AS pos FROM (SELECT DISTINCT r, start, size FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.KINDS],
                      F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op5_suffix_array_dedup"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS p FROM d)),
m AS (SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY s) AS first_id FROM w) WHERE first_id < doc_id),
c AS (SELECT DISTINCT r, b FROM (SELECT r, unnest(range(p, p + 50)) AS b FROM m)),
g AS (SELECT r, count(*) AS n_removed, count(*) FILTER (WHERE prev IS NULL OR prev < b - 1) AS n_spans
      FROM (SELECT r, b, lag(b) OVER (PARTITION BY r ORDER BY b) AS prev FROM c) GROUP BY r),
k AS (SELECT r, string_agg(substr(h, 2 * b + 1, 2), '' ORDER BY b) AS h
      FROM (SELECT r, h, unnest(range(0, n)) AS b FROM d) ANTI JOIN c USING (r, b) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)
"""


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_frame(spark, URL_RULES))
    return out.withColumnRenamed("id", "page_id")


ORACLE["op6_url_filter"] = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, max({'size': length(rhost) + length(rpath), 'rule': rhost || rpath, 'action': action}) AS best
  FROM (SELECT DISTINCT page_id, host, path FROM urls) u
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
FROM urls u LEFT JOIN fits USING (page_id)
"""


@query
def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arc_warc.archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base 32 takes 5 bits a letter: 5 hex digits are 20 bits, 4 letters.
ORACLE["op7_arc_to_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)))::INTEGER & 31), 1)), 'string_agg', '') AS payload_digest
  FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels, train_on=~held_out(F.col("doc_id")))
    return _scored(quality.score(docs, model), 0.3)


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20)
    return out.withColumnRenamed("id", "vec_id")


ORACLE["op10_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = va_clusters.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10, dims=64, scale=1024.0, seed="3")
    return out.withColumnRenamed("id", "vec_id")


def _rounds_sql(k: int, rounds: int, dims: int) -> str:
    """k-means in SQL: one pair of steps (nearest, means) a round."""
    near = """a{i} AS MATERIALIZED (
  SELECT r, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT r, c, list_sum(list_transform(range(1, {dims1}), lambda j: (v.e[j] - m.e[j]) * (v.e[j] - m.e[j])))::BIGINT AS d FROM v, c{i} m) GROUP BY r)"""
    mean = """c{j} AS MATERIALIZED (
  SELECT c, coalesce(n.e, o.e) AS e FROM c{i} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS e FROM (
      SELECT best.c AS c, p, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT best, unnest(v.e) AS x, unnest(range(1, {dims1})) AS p FROM v JOIN a{i} USING (r)) GROUP BY ALL) GROUP BY c) n USING (c))"""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS c, e FROM (
    SELECT sha256('3:' || vec_id::VARCHAR) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT {k}))"""]
    for i in range(rounds):
        parts += [near.format(i=i, dims1=dims + 1), mean.format(i=i, j=i + 1, dims1=dims + 1)]
    parts.append(near.format(i=rounds, dims1=dims + 1))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.e, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} m ON m.c = best.c"""


ORACLE["op11_centroid_clustering"] = _rounds_sql(8, 10, 64)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, words joined by one space, with the contract's repeats: of a
    tenth of the documents (by crc32 of the id) the words from ``a`` on go on
    with period ``p``. A null id has none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def let(value: Column, body) -> Column:
        """``value`` is computed once, however often the body uses it."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def repeated(words: Column, a: Column) -> Column:
        n = F.size(words)
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = let(p, lambda p: F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \x09-\x0D]+"), "")
    changed = let(words, lambda w: F.when(F.size(w) > 0, let((g % F.size(w)).cast("int"), lambda a: repeated(w, a))).otherwise(F.lit("")))
    return F.when(h % 10 == 0, changed).otherwise(text)


@query
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = word_runs.find_runs(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), "")
    # runs are by start, then period: the first of equal exponents stays
    most = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best))
    return out.withColumn("best", most).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


# crc32, a bit at a time: -1 is a shift, anything else a byte.
ORACLE["op12_word_runs"] = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
crc AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h, len(w) AS n FROM base),
cut AS (SELECT r, doc_id, w, n, h, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM crc),
per AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
docs AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w
  FROM per),
x AS MATERIALIZED (SELECT r, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM docs),
same AS (SELECT a.r, b.i - a.i AS q, a.i AS i FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
island AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k),
long AS MATERIALIZED (SELECT * FROM island WHERE len >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT * FROM long WHERE NOT EXISTS (
  SELECT 1 FROM long o WHERE o.r = long.r AND o.q < long.q AND long.q % o.q = 0 AND o.s <= long.s AND o.s + o.len >= long.s + long.len)),
best AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
                first({'s': s, 'len': len, 'q': q} ORDER BY len / q DESC, s, q) AS top FROM run GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM x
         WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.r = x.r AND run.s + run.q <= x.i AND x.i < run.s + run.len) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.len::BIGINT AS length, top.q::BIGINT AS period,
       ((1000 * top.len) // top.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join("labels", ",").alias("labels"), "score")
