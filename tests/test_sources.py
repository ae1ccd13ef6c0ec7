"""Readers and writers on small files written to a temporary folder."""

import datetime as dt
import json
import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from stayspark.operators.clean import clean_and_enrich, map_columns
from stayspark.sources import files as FS
from stayspark.sources import market_store as MS
from stayspark.sources.text_table import text_table_lines, to_columns

CSV = ('"""R_ID""";"R_STATUS";"R_ARRIVAL";"R_DEPARTURE";"R_NIGHTS";"R_TOTAL_AMOUNT";"R_PROPERTY_NAME";"R_SOURCE"\n'
       '1;Booked;03/10/2024;06/10/2024;3;"EUR 1.234,56";Casa Peñiscola;booking.com\n'
       '2;Fact.;04/10/2024;05/10/2024;;"$1,234.56";Casa Peñiscola;\n'
       '3;Annuled;05/10/2024;07/10/2024;2;"99";Apto Valencia;AIRBNB\n')


def write(path, text, encoding="latin-1"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_csv_sniff_and_clean(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "rows.csv"), CSV)
    assert FS.sniff_separator(spark, p) == ";"
    raw = FS.load_file(spark, p)
    assert raw.columns[0] == "R_ID" and len(raw.columns) == 8
    assert map_columns(raw)["amount"] == "R_TOTAL_AMOUNT" and map_columns(raw)["owner"] is None
    c = clean_and_enrich(raw).orderBy("id").collect()
    assert [r.amount for r in c] == [1234.56, 1234.56, 99.0]
    assert [r.nights for r in c] == [3.0, 1.0, 2.0]
    assert [r.status_group for r in c] == ["Confirmada", "Confirmada", "Cancelada"]
    assert c[0].property == "Casa Peñiscola" and c[1].channel == "Directo / Sin canal"
    assert c[0].arrival == dt.datetime(2024, 10, 3)


def test_csv_comma_and_fallback(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "c.csv"), "id,amount,property\n1,10,A\n")
    assert FS.sniff_separator(spark, p) == ","
    p2 = write(os.path.join(tmpdir_path, "two.csv"), "a;b\n1;2\n")
    assert FS.sniff_separator(spark, p2) == ";"
    with pytest.raises(ValueError):
        FS.sniff_separator(spark, p2, strict=True)
    with pytest.raises(ValueError):
        FS.load_file(spark, os.path.join(tmpdir_path, "x.json"))


def _xlsx_bytes(rows):
    shared, idx = [], {}
    sheet_rows = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            ref = chr(65 + c) + str(r)
            if isinstance(v, str):
                if v not in idx:
                    idx[v] = len(shared)
                    shared.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{idx[v]}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        sheet_rows.append(f'<row r="{r}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel_ns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel_ns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/>'
                                      f'</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(sheet_rows)}</sheetData></worksheet>')
    return buf.getvalue()


def test_xlsx_reader(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "books")
    os.makedirs(d)
    with open(os.path.join(d, "a.xlsx"), "wb") as f:
        f.write(_xlsx_bytes([["property", "amount", "arrival"], ["Casa", 120, "01/02/2024"], ["Apto", 80.5, None]]))
    df = FS.read_xlsx(spark, d + "/*.xlsx")
    assert df.columns == ["property", "amount", "arrival"]
    assert sorted(tuple(r) for r in df.collect()) == [("Apto", "80.5", None), ("Casa", "120", "01/02/2024")]


def _docx_bytes(tables=None, paragraphs=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = ""
    for t in tables or []:
        body += "<w:tbl>" + "".join(
            "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>"
            for row in t) + "</w:tbl>"
    body += "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return buf.getvalue()


def test_docx_tables_and_paragraphs(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.docx")
    with open(p, "wb") as f:
        f.write(_docx_bytes([[["property", "amount"], ["Casa", " 100 "]], [["Apto", "50"]]]))
    df = FS.load_file(spark, p)
    assert df.columns == ["property", "amount"]
    assert sorted(tuple(r) for r in df.collect()) == [("Apto", "50"), ("Casa", "100")]
    p2 = os.path.join(tmpdir_path, "p.docx")
    with open(p2, "wb") as f:
        f.write(_docx_bytes(paragraphs=["Contrato", "  ", "Firmado"]))
    assert [r.texto for r in FS.read_docx(spark, p2).collect()] == ["Contrato", "Firmado"]


def test_text_table_lines(spark):
    docs = spark.createDataFrame([(1, "a  b c\n\n  d\te  \nlast")], "doc_id long, text string")
    got = [(r.line_no, list(r.cells)) for r in text_table_lines(docs).orderBy("line_no").collect()]
    assert got == [(0, ["a", "b", "c"]), (2, ["d", "e"]), (3, ["last"])]
    wide = to_columns(text_table_lines(docs), 3).orderBy("line_no").collect()
    assert tuple(wide[1])[2:] == ("d", "e", None)


def test_market_csv_store_and_snapshot(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "m.csv"),
              "﻿nombre,precio_noche,rating,num_reviews,tipo,capacidad,url,fecha_scraping,checkin,checkout,"
              "ciudad,propiedad_referencia\nA,100,4.5,10,Cabaña,2,u1,2026-07-01,2026-07-15,2026-07-18,Valencia,P\n"
              "B,bad,,,,,u2,2026-07-01,2026-07-15,2026-07-18,Valencia,P\n", encoding="utf-8")
    m = MS.read_market_csv(spark, p)
    rows = {r.nombre: r for r in m.collect()}
    assert rows["A"].precio_noche == 100 and rows["A"].checkin == dt.date(2026, 7, 15)
    assert rows["B"].precio_noche is None
    root = os.path.join(tmpdir_path, "store")
    MS.append_batch(m, root, "run", 0)
    newer = m.where("nombre = 'A'").withColumn("precio_noche", m.precio_noche + 1)
    MS.append_batch(newer, root, "run", 1)
    MS.append_batch(newer, root, "run", 1)  # replayed batch: written once
    MS.append_batch(newer.withColumn("url", F.lit("u3")), root, "other", 0)  # another run's batch 0
    cur = {r.url: r.precio_noche for r in MS.current_listings(spark, root, ["fecha_scraping"]).collect()}
    assert cur == {"u1": 101, "u2": 0, "u3": 101}
    with pytest.raises(ValueError):
        MS.current_listings(spark, root, [])
    MS.compact(spark, root, root + "2", ["fecha_scraping"])
    assert {r.url: r.precio_noche for r in MS.current_listings(spark, root + "2", ["fecha_scraping"]).collect()} == cur
    snap = MS.snapshot(MS.current_listings(spark, root, ["fecha_scraping"]), os.path.join(tmpdir_path, "snaps"), dt.date(2026, 7, 2))
    assert snap.endswith("snapshot_date=20260702") and spark.read.parquet(snap).count() == 3


def test_written_and_dropped(spark):
    from stayspark.session import drop_written, run_folder, written
    a, b = (written(spark.range(10).selectExpr("id * 2 AS x"), "t") for _ in range(2))
    assert sorted(r.x for r in a.collect()) == list(range(0, 20, 2))
    assert "Range" not in a._jdf.queryExecution().optimizedPlan().toString()
    drop_written(spark, a)
    assert not os.path.exists(a.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]) and b.count() == 10
    assert os.listdir(run_folder(spark).removeprefix("file:"))


def test_market_csv_keeps_rows_with_decimals(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "m.csv"), "url,extra,precio_noche,num_reviews,rating,capacidad\nu1,x,120.0,7.0,4.5,2\nu2,x, 99 ,a,,\nu3,x,1e12,,,3.9\n", "utf-8")
    from stayspark.operators.market import coerce_market, upsert_listings
    m = MS.read_market_csv(spark, p)
    rows = {r.url: (r.precio_noche, r.num_reviews, r.rating, r.capacidad, r.checkin) for r in m.collect()}
    assert rows == {"u1": (120, 7, 4.5, 2, None), "u2": (99, None, None, None, None), "u3": (None, None, None, 3, None)}
    assert coerce_market(m).count() == 2
    assert {r.url: r.precio_noche for r in upsert_listings(None, m).collect()} == {"u1": 120, "u2": 99, "u3": 0}


def _listings(spark, rows):
    return spark.createDataFrame(rows, "url string, checkin date, precio_noche int, fecha_scraping string")


def test_listing_store_merges_only_what_a_batch_touches(spark, tmpdir_path):
    root, day = os.path.join(tmpdir_path, "store"), dt.date(2026, 7, 1)
    store = MS.ListingStore(spark, root, ["fecha_scraping"], buckets=8)
    assert store.listings() is None and store.versions() == []
    first = [(f"u{i}", day, i, "2026-07-01") for i in range(60)] + [("u0", day, 5, "2026-06-01"), (None, None, 3, "2026-07-01")]
    assert store.merge(_listings(spark, first), "run", 0) == 1
    before = store.manifest()
    assert store.merge(_listings(spark, [("u7", day, 700, "2026-07-02"), ("u8", day, 800, "2026-06-30")]), "run", 1) == 2
    after = MS.ListingStore(spark, root, ["fecha_scraping"]).manifest()  # the store knows its buckets
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and set(after) == set(before)
    want = {f"u{i}": i for i in range(60)} | {"u7": 700, None: 3}
    assert {r.url: r.precio_noche for r in store.listings().collect()} == want
    assert {r.url: r.precio_noche for r in store.listings(1).collect()} == want | {"u7": 7}
    store.merge(_listings(spark, [("u7", day, 700, "2026-07-02")]), "run", 1)  # a replayed batch
    assert store.merge(_listings(spark, []), "run", 2) == 3
    assert {r.url: r.precio_noche for r in store.listings().collect()} == want
    store.vacuum(keep=1)
    assert store.versions() == [3] and len(os.listdir(os.path.join(root, "state"))) == len(set(store.manifest().values()))
    assert {r.url: r.precio_noche for r in store.listings().collect()} == want
    with pytest.raises(ValueError):
        store.listings(1)


def test_listing_store_is_dealt_by_the_key_once(spark, tmpdir_path, monkeypatch):
    """Buckets are those of Spark's hash partitioning by the key, so a merge
    needs no shuffle after the aggregate's."""
    from pyspark.sql import functions as F
    root, day = os.path.join(tmpdir_path, "store"), dt.date(2026, 7, 1)
    store = MS.ListingStore(spark, root, ["fecha_scraping"], buckets=8)
    first = _listings(spark, [(f"u{i}", day, i, "a") for i in range(60)] + [("u1", day, 99, "b"), (None, None, 3, "a")])
    monkeypatch.setattr(type(first), "repartition", None)
    store.merge(first, "run", 0)
    text = first.limit(0).unionByName(_listings(spark, [("u2", day, 200, "b")])).withColumn("checkin", F.col("checkin").cast("string"))
    assert store.merge(text, "run", 1) == 2  # the key takes the store's types
    for b, folder in store.manifest().items():
        df = spark.read.parquet(f"{root}/state/{folder}/bucket={b}")
        assert {r[0] for r in df.select(F.pmod(F.hash("url", "checkin"), F.lit(8))).collect()} == {b}
    assert {r.url: r.precio_noche for r in store.listings().collect()} == {f"u{i}": i for i in range(60)} | {"u1": 99, "u2": 200, None: 3}


def test_listing_store_of_an_earlier_hash(spark, tmpdir_path, monkeypatch):
    """A manifest without the name of its hash goes on with xxhash64."""
    root, day = os.path.join(tmpdir_path, "store"), dt.date(2026, 7, 1)
    with monkeypatch.context() as m:
        m.setattr(MS, "_HASHED", "xxhash64")
        MS.ListingStore(spark, root, ["fecha_scraping"], buckets=8).merge(_listings(spark, [(f"u{i}", day, i, "a") for i in range(40)]), "run", 0)
    for name in os.listdir(os.path.join(root, "manifests")):  # the manifest and its checksum
        path = os.path.join(root, "manifests", name)
        if name == "1":
            row = json.load(open(path))
            del row["hashed"]
            made = json.dumps(row)
        else:
            os.remove(path)
    with open(os.path.join(root, "manifests", "1"), "w") as f:
        f.write(made)
    store = MS.ListingStore(spark, root, ["fecha_scraping"])
    store.merge(_listings(spark, [(f"u{i}", day, -i, "b") for i in range(1, 40, 2)]), "run", 1)
    assert sorted((r.url, r.precio_noche) for r in store.listings().collect()) == sorted((f"u{i}", -i if i % 2 else i) for i in range(40))


def test_killed_or_second_writer_leaves_the_old_version(spark, tmpdir_path, monkeypatch):
    root, day = os.path.join(tmpdir_path, "store"), dt.date(2026, 7, 1)
    store = MS.ListingStore(spark, root, ["fecha_scraping"], buckets=4)
    store.merge(_listings(spark, [("u1", day, 1, "a")]), "run", 0)

    def die(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(MS.ListingStore, "_publish", die)  # after the state is written, before the manifest
        with pytest.raises(KeyboardInterrupt):
            store.merge(_listings(spark, [("u1", day, 2, "b")]), "run", 1)
    assert [r.precio_noche for r in MS.ListingStore(spark, root, ["fecha_scraping"]).listings().collect()] == [1]
    with monkeypatch.context() as m:
        m.setattr(MS.ListingStore, "versions", lambda self: [])  # a writer that saw no version
        with pytest.raises(RuntimeError, match="another writer"):
            store.merge(_listings(spark, [("u1", day, 3, "c")]), "other", 0)
    assert store.versions() == [1] and [r.precio_noche for r in store.listings().collect()] == [1]
    store.merge(_listings(spark, [("u1", day, 2, "b")]), "run", 1)
    assert [r.precio_noche for r in store.listings().collect()] == [2]
    store.vacuum(1)
    assert len(os.listdir(os.path.join(root, "state"))) == 1


def test_snapshots_as_of_and_diff(spark, tmpdir_path):
    root, day = os.path.join(tmpdir_path, "snaps"), dt.date(2026, 8, 1)
    assert MS.snapshot_at(spark, root, day) is None
    MS.snapshot(_listings(spark, [("a", day, 1, "x"), ("b", day, 2, "x"), ("c", None, 3, "x"), ("d", day, None, "x")]), root, dt.date(2026, 7, 1))
    MS.snapshot(_listings(spark, [("b", day, 5, "x"), ("c", None, 3, "x"), ("d", day, None, "x"), ("e", day, None, "x")]), root, dt.date(2026, 7, 9))
    assert MS.snapshot_dates(spark, root) == [dt.date(2026, 7, 1), dt.date(2026, 7, 9)]
    assert MS.snapshot_at(spark, root, dt.date(2026, 6, 30)) is None
    old, new = MS.snapshot_at(spark, root, dt.date(2026, 7, 8)), MS.snapshot_at(spark, root, dt.date(2026, 7, 9))
    assert sorted((r.url, r.change, r.old_price, r.new_price) for r in MS.snapshot_diff(old, new).collect()) == [
        ("a", "gone", 1, None), ("b", "repriced", 2, 5), ("e", "added", None, None)]
    assert MS.snapshot_diff(old, old).count() == 0
    one = MS.snapshots(spark, root).where(F.col("snapshot_date") == dt.date(2026, 7, 9))
    assert one.count() == 4


def test_planner_csv_strict(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "rows.csv"), CSV)
    from stayspark.operators.planner import search_inputs
    si = search_inputs(FS.read_planner_bookings(spark, p)).collect()
    assert sorted((r.propiedad, r.ciudad, str(r.checkin), r.noches) for r in si) == [
        ("Casa Peñiscola", "Peñíscola", "2024-10-03", 3), ("Casa Peñiscola", "Peñíscola", "2024-10-04", 1)]


def test_csv_folder_of_other_layouts(spark, tmpdir_path):
    """Each file by its own header; line breaks in quotes; words for missing."""
    write(os.path.join(tmpdir_path, "a.csv"), 'id;status;amount\n1;Booked;"10\n20"\n2;NULL;n/a\n')
    write(os.path.join(tmpdir_path, "b.csv"), "amount,id,guest\n30,3,Ana\n")
    got = sorted((r["id"], r["status"], r["amount"], r["guest"]) for r in FS.read_bookings_csv(spark, tmpdir_path).collect())
    assert got == [("1", "Booked", "10\n20", None), ("2", None, None, None), ("3", None, "30", "Ana")]


def test_workbooks_and_documents_of_other_layouts(spark, tmpdir_path):
    for name, rows in (("a", [["id", "amount"], ["1", "10"], ["2", "20", "extra"]]), ("b", [["amount", "id"], ["30", "3"]])):
        with open(os.path.join(tmpdir_path, f"{name}.xlsx"), "wb") as f:
            f.write(_xlsx_bytes(rows))
    got = sorted((r["id"], r["amount"], r["_2"]) for r in FS.read_xlsx(spark, tmpdir_path + "/*.xlsx").collect())
    assert got == [("1", "10", None), ("2", "20", "extra"), ("3", "30", None)]
    for name, t, p in (("a", [[["id", "amount"], ["1", "10"]]], ()), ("b", [[["id", "amount"], ["2", "20"]]], ()), ("c", None, ["Texto"])):
        with open(os.path.join(tmpdir_path, f"{name}.docx"), "wb") as f:
            f.write(_docx_bytes(t, p))
    got = sorted(((r["id"], r["amount"], r["texto"]) for r in FS.read_docx(spark, tmpdir_path + "/*.docx").collect()), key=str)
    assert got == [("1", "10", None), ("2", "20", None), (None, None, "Texto")]


def test_store_keeps_the_same_row_however_dealt(spark, tmpdir_path):
    rows = [("u", "2026-07-15", i, "2026-07-01") for i in range(500)]
    df = spark.createDataFrame(rows, "url string, checkin string, precio_noche int, fecha_scraping string")
    from stayspark.operators.market import upsert_listings
    kept = {upsert_listings(None, df.repartition(n), order=["fecha_scraping"]).first().precio_noche for n in (1, 2, 5, 7)}
    assert len(kept) == 1


def test_text_columns_lose_nothing(spark):
    lines = text_table_lines(spark.createDataFrame([(1, "a b c\nd")], "doc_id long, text string"))
    assert to_columns(lines).columns == ["doc_id", "line_no", "_0", "_1", "_2"]
    with pytest.raises(Exception, match="cells"):
        to_columns(lines, 2).collect()


def test_only_files_with_open_quotes_are_read_whole(spark, tmpdir_path):
    """Files without line breaks in quotes are split; the others lose none."""
    n = 3000
    plain = "id;status;note\n" + "".join(f'{i};"a;b";"say ""hi"""\n' if i % 2 else f'{i};"";x\n' for i in range(n))
    write(os.path.join(tmpdir_path, "plain.csv"), plain)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = FS.read_bookings_csv(spark, tmpdir_path)
        assert df.rdd.getNumPartitions() > 1
        assert {(r["id"], r["status"], r["note"]) for r in df.collect()} == {
            (str(i), "a;b", 'say "hi"') if i % 2 else (str(i), None, "x") for i in range(n)}
        # The break hides behind an even number of quotes in "stray"; breaks at a field's end and in blank lines.
        write(os.path.join(tmpdir_path, "breaks.csv"), 'id;status;note\nb1;ok;"two\n\nlines ""x"""\nb2;"end\n";z\n')
        write(os.path.join(tmpdir_path, "stray.csv"), 'id;status;note\ns1;5" tv;"open\nclosed"\ns2;ok;z\n')
        df = FS.read_bookings_csv(spark, tmpdir_path)
        got = {(r["id"], r["status"], r["note"]) for r in df.collect()}
        assert len(got) == df.count() == n + 4
        assert {r for r in got if not r[0].isdigit()} == {
            ("b1", "ok", 'two\n\nlines "x"'), ("b2", "end\n", "z"), ("s1", '5" tv', "open\nclosed"), ("s2", "ok", "z")}
        assert got == {tuple(r) for r in FS.read_bookings_csv(spark, tmpdir_path, multiline=True).select("id", "status", "note").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _quoted_csv(seed: int, sep: str) -> tuple[str, list[list[str]]]:
    """A CSV with line breaks, separators and quotes in quoted fields, quotes
    inside plain ones, and its rows."""
    rnd = random.Random(seed)
    pieces = ["a", "bb", " ", '"', sep, "\n", "\n\n", '""', "é", "x y"]
    rows, text = [], sep.join(["id", "name", "note", "last"]) + "\n"
    for i in range(60):
        row, out = [str(i)], [str(i)]
        for _ in range(2):
            v = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 9)))
            if any(ch in v for ch in '"\n' + sep) or rnd.random() < 0.3:
                out.append('"' + v.replace('"', '""') + '"')
            else:
                out.append(v)
            row.append(v)
        plain = rnd.choice(["end", '5" pipe', "z" * rnd.randrange(1, 200)])
        rows.append(row + [plain])
        text += sep.join(out + [plain]) + "\n"
    return text, rows


@pytest.mark.parametrize("size,sep,seeds", [(37, ";", [0]), (150, ",", [1, 2]), (1 << 20, ";", [3])])
def test_quoted_line_breaks_are_read_in_splits(spark, tmpdir_path, size, sep, seeds):
    for seed in seeds:
        text, rows = _quoted_csv(seed, sep)
        d = os.path.join(tmpdir_path, f"d{seed}")
        os.makedirs(d)
        write(os.path.join(d, "a.csv"), text)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            got = FS.quoted_records(spark, [os.path.join(d, "a.csv")], sep).select("record").collect()
            df = FS.read_bookings_csv(spark, os.path.join(d, "a.csv"), multiline=True)
            read = sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        whole = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, encoding="ISO-8859-1").csv(os.path.join(d, "a.csv"))
        assert len(got) == 61
        assert read == sorted((tuple(r) for r in whole.collect()), key=lambda r: int(r[0])) == [tuple(r) for r in rows]


def test_records_over_many_splits_and_crlf(spark, tmpdir_path):
    long = "\n".join(str(i) for i in range(200))
    p = write(os.path.join(tmpdir_path, "long.csv"), f'a;b;c\n1;"{long}";x\n2;"";"y"\n\n3;"q\nopen;never closed\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    try:
        got = {r.a: (r.b, r.c) for r in FS.read_bookings_csv(spark, p).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["1"] == (long, "x") and got["2"][1] == "y" and got["3"][0].startswith("q\nopen")
    p = os.path.join(tmpdir_path, "crlf.csv")
    with open(p, "wb") as f:
        f.write(b'a;b;c\r\n1;"x\r\ny";2\r\n3;4;5\r\n')
    assert sorted(tuple(r) for r in FS.read_bookings_csv(spark, p).collect()) == [("1", "x\r\ny", "2"), ("3", "4", "5")]


def test_any_number_of_layouts(spark, tmpdir_path, monkeypatch):
    """Files of other separators, columns and orders, some with breaks in
    quotes: read by position as one by one."""
    for i in range(12):
        sep = ";,\t"[i % 3]
        names = ["id", "amount", f"extra{i % 5}", "Ñame"]
        names = names[i % 4:] + names[: i % 4]
        value = {"id": str(i), "amount": f"{i}.5", f"extra{i % 5}": '"two\nlines"' if i % 4 == 0 else f"e{i}", "Ñame": "é"}
        text = sep.join(f'"{n}"' for n in names) + "\n" + sep.join(value[n] for n in names) + "\n" + sep.join(["x", "NULL", "y"]) + "\n"
        write(os.path.join(tmpdir_path, f"f{i:02}.csv"), text)

    def read():
        df = FS.read_bookings_csv(spark, tmpdir_path)
        return sorted(str(sorted(r.asDict().items())) for r in df.collect())
    one_by_one = read()
    monkeypatch.setattr(FS, "MAX_LAYOUTS", 3)
    assert read() == one_by_one and len(one_by_one) == 24
