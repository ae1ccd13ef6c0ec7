import pytest

from stayspark.llm import arc_warc as A

ROWS = [(5, "http://a/", "<p>same\r\n\r\nWARC/1.1\n</p>"), (3, "http://b/ c\nd", "<p>same\r\n\r\nWARC/1.1\n</p>"), (9, None, None), (8, "", ""),
        (None, "http://n/", "<p>same\r\n\r\nWARC/1.1\n</p>"), (None, "u", "lonely é\n\n"), (11, "x://é", "HTTP/1.1 200\r\n\r\nx"),
        (12, "u", "long " * 50_000), (3, "http://b/ c\nd", "<p>same\r\n\r\nWARC/1.1\n</p>"), (13, "u", "\n"), (14, "u", "\n\n\r\n")]


def brute(rows):
    body = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in body:
        first = min((j for j, c in body if c == b and j is not None), default=None)
        revisit = first is not None and i != first
        out.append((i, len(b), A.sha1_base32(b), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("segment", [100, 8 << 20])
def test_round_trip(spark, monkeypatch, version, segment):
    monkeypatch.setattr(A, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(A, "BROADCAST_ROWS", 0 if segment == 100 else 50_000)
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload string").repartition(3)
    out = A.archive_pages(df, version)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
    assert sorted(got, key=str) == brute(ROWS)
    text = {r.page_id: bytes(r.payload).decode() for r in out.where("record_type = 'response' and page_id is not null").collect()}
    assert all(text[i] == (h or "") for i, _, h in ROWS if i in text)
    assert A.archive_pages(df.where("false")).count() == 0


def test_arc_versions_and_errors():
    for v in (1, 2):
        body = A.arc_start("n.arc", v) + A.arc_record("n.arc", v, "http://x/", "2001", "text/html", b"a\nb\n") + b"\n" + \
            A.arc_record("n.arc", v, "u", "20010203040506", "t", b"")
        got = list(A.parse_arc(body))
        assert [b for _, b in got] == [b"a\nb\n", b""] and got[0][0]["URL"] == "http://x/" and got[1][0]["Archive-length"] == "0"
    assert A.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and A.warc_date("2001") == "2001-01-01T00:00:00Z"
    assert A.warc_date("x") == "1970-01-01T00:00:00Z"
    start = A.arc_start("n", 1)
    spaced = next(A.parse_arc(start + b"http://a b c 1.2.3.4 2001 text/html 2\nhi\n"))
    assert spaced[0]["URL"] == "http://a b c"
    for bad in (b"http://x 1 2 t 9\nab", b"nonsense\n", b"http://x 1 2 t 2"):
        with pytest.raises(ValueError):
            list(A.parse_arc(start + bad))


def test_revisits_need_bytes(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in A.archive_pages(df, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    ids = {(r.page_id, r.record_id) for r in A.archive_pages(df).collect()}
    assert ids == {(r.page_id, r.record_id) for r in A.archive_pages(df.repartition(2), 2).collect()}
