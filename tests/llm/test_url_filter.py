import random

import pytest
from pyspark.sql import functions as F

from stayspark.llm import url_filter as U


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, after = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        cut = min([after.find(c) for c in "?#" if c in after], default=len(after))
        path = after[:cut]
    fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://NET/", "http://a.net", "https://É.Example.NET/en/x?y#z", "x://example.com/de/..",
        "http://example.com/de", "http://org/fr/", "ftp://u@h.org:80/fr/a://b", "http://anet/", "http://.net/", "http://net./",
        "http://a.b.net?x/", "http://a.b.net#/", "http://x.net//", "http://a\nb.net/\nen", "http://" + "a." * 300 + "net/" + "p" * 5000]


def test_rules(spark):
    from stayspark.llm.queries import URL_RULES as rules
    rows = [(i if i else None, u, "clash") for i, u in enumerate(URLS + URLS[:5])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = U.judge(df, U.rules_frame(spark, rules)).collect()
    want = sorted(str((i, *brute(u, rules))) for i, u, _ in rows)
    assert sorted(str(tuple(r)) for r in got) == want
    assert U.judge(df.where("false"), U.rules_frame(spark, rules)).count() == 0
    assert {r.verdict for r in U.judge(df, U.rules_frame(spark, [])).collect()} == {"allow"}


def test_many_rules_and_false_positives(spark, monkeypatch):
    """Small levels give many false positives; the cascade stays exact."""
    monkeypatch.setattr(U, "LEAST_BITS", 64)
    rnd = random.Random(3)
    name = lambda: rnd.choice("abcdefgh") + rnd.choice("abcdefgh") + "." + rnd.choice(["com", "net"])
    rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in
                  ((name(), rnd.choice(["/", "/a", "/a/b"])) for _ in range(60))}.values())
    urls = [(i, f"http://{rnd.choice(['', 'w.'])}{name()}{rnd.choice(['', '/', '/a', '/a/b/c'])}") for i in range(1500)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {tuple(r) for r in U.judge(df, U.rules_frame(spark, rules)).collect()}
    assert got == {(i, *brute(u, rules)) for i, u in urls}


def test_cascade_levels(spark, monkeypatch):
    monkeypatch.setattr(U, "LEAST_BITS", 64)
    universe = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    keys = universe.where("cast(key as int) % 7 = 0")
    levels = U.build_cascade(keys, universe)
    assert len(levels) > 2
    wrong = universe.where(U.listed(F.col("key"), levels) != (F.col("key").cast("int") % 7 == 0))
    assert wrong.count() == 0


@pytest.mark.parametrize("most", [1_000_000, 9])
def test_long_lists(spark, monkeypatch, most):
    """Two million listed keys of which a few occur, more path lengths than
    a thousand, and (with a low bound) several cascades."""
    monkeypatch.setattr(U, "MAX_LISTED", most)
    rnd = random.Random(5)
    few = [(rnd.choice(["allow", "block"]), f"h{i}.net", "/" + "p" * n) for i in range(40) for n in (0, i * 29)]
    few = list({(h, p): (a, h, p) for a, h, p in few}.values())
    many = spark.range(2_000_000 if most > 9 else 2000).select(F.when(F.col("id") % 2 == 0, "allow").otherwise("block").alias("action"),
                                                               F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(".org")).alias("host"),
                                                               F.concat(F.lit("/"), F.repeat(F.lit("q"), (F.col("id") % 1100).cast("int"))).alias("path"))
    urls = [(i, f"http://w.H{rnd.randrange(45)}.net/{'p' * rnd.randrange(1200)}") for i in range(300)] + [(900 + i, f"http://x{i}.org/{'q' * 1200}") for i in range(20)]
    rules = U.rules_frame(spark, [(a, h.upper(), p) for a, h, p in few]).unionByName(many)
    known = few + [(["allow", "block"][i % 2], f"x{i}.org", "/" + "q" * (i % 1100)) for i in range(20)]
    got = sorted(tuple(r) for r in U.judge(spark.createDataFrame(urls, "page_id long, url string"), rules).collect())
    assert got == sorted((i, *brute(u, known)) for i, u in urls)


def test_unknown_action(spark):
    with pytest.raises(ValueError, match="deny"):
        U.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), U.rules_frame(spark, [("deny", "net", "/")]))
