"""Booking file readers (S1-S5): CSV with separator sniffing, spreadsheets
and documents. Every reader returns all-string columns named by the file
header, ready for :func:`stayspark.operators.clean.clean_and_enrich`.

Spreadsheets and documents are zip archives of XML; they are read as
binary files and parsed with the standard library inside ``mapInPandas``
(one task per file), so a directory of thousands of files is spread over
the cluster. PDF byte decoding is not built: extracted text goes through
:func:`stayspark.sources.text_table.text_table_lines` (S6).
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = [";", ",", "\t"]


# Words that a spreadsheet export writes for a missing value (fixed values).
MISSING_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
                 "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Different header lines that are read one by one; of more, the files of a separator are read together, by position.
MAX_LAYOUTS = 100


# -- S2 / S3: delimited text ---------------------------------------------------

def _header_fields(line: str, sep: str) -> list[str]:
    try:
        return next(csv.reader([line], delimiter=sep, quotechar='"'))
    except (csv.Error, StopIteration):
        return []


def _layouts(spark: SparkSession, path: str, encoding: str) -> dict[str, list[str]]:
    """Files by their first non-blank line (a list as long as the folder's)."""
    # the text source keeps bytes as they are
    lines = (spark.read.text(path)
             .select(F.decode(F.col("value").cast("binary"), encoding).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                     F.monotonically_increasing_id().alias("line"))
             .where("at = 0 and trim(value) <> ''"))
    # Ids grow along a file's first block; the least is its first line.
    heads = lines.groupBy("file").agg(F.min_by("value", "line").alias("head"))
    found = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return {r.head: r.files for r in sorted(found, key=lambda r: r.files[0])}


def _separator(head: str) -> str | None:
    """First of ``;`` ``,`` tab that gives more than 2 header fields."""
    return next((sep for sep in SEPARATORS if len(_header_fields(head, sep)) > 2), None)


def sniff_separator(spark: SparkSession, path: str, strict: bool = False, encoding: str = "ISO-8859-1") -> str:
    """Separator of the file (of the first file of a folder): ``;`` when none
    gives more than 2 header fields, or ``ValueError`` when ``strict``, as
    the planner does."""
    heads = list(_layouts(spark, path, encoding))
    sep = _separator(heads[0]) if heads else None
    if sep is None and strict:
        raise ValueError(f"no separator gives more than 2 columns in {path}")
    return sep or ";"


def clean_header(name: str) -> str:
    return name.replace('"', "").strip()


def _raw_lines(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """(value, file, at, line): lines by their split, in order. The text source
    keeps bytes as they are, so they are decoded here."""
    value = F.decode(F.col("value").cast("binary"), encoding).alias("value")
    return (spark.read.option("lineSep", "\n").text(files)
            .select(value, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                    F.monotonically_increasing_id().alias("line")))


def _leaves_open(sep: str) -> tuple[Column, Column]:
    """Whether a quoted field is open at the end of the line ``value``: if it
    began outside quotes, and if it began inside.

    A doubled quote is a quote's text wherever it stands, so it goes first. A
    field is quoted only if its first character is a quote; a quote elsewhere
    in a field is text.
    """
    s = re.escape(sep)
    plain = F.replace("value", F.lit('""'), F.lit(""))

    def outside(line: Column) -> Column:
        # whole quoted fields go, then a quote that starts a field has no end
        return F.regexp_like(F.regexp_replace(line, f'(^|{s})"[^"]*"', "$1x"), F.lit(f'(^|{s})"'))

    # inside: the first quote ends the field; what follows up to the separator is text
    first = F.instr(plain, '"')
    rest = F.concat(F.lit("x"), F.substr(plain, first + 1, F.length(plain)))
    return outside(plain), F.when(first == 0, F.lit(True)).otherwise(outside(rest))


def _runs_on(opens: Column, keeps: Column, order: str, part: list[str]) -> Column:
    """State after each row, as (known, state, flips): if ``known``, ``state``
    whatever came before the part; else the state before it, turned over if
    ``flips`` is odd. Rows map outside -> ``opens``, inside -> ``keeps``: a map
    is constant (both equal), does nothing, or turns over."""
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum((opens & ~keeps).cast("long")).over(upto)
    last = F.last(F.when(opens == keeps, F.struct(opens.alias("state"), flips.alias("at"))), ignorenulls=True).over(upto)
    return F.struct(last.isNotNull().alias("known"), F.coalesce(last.state, F.lit(False)).alias("state"),
                    (flips - F.coalesce(last["at"], F.lit(0))).alias("flips"))


def _after(run: Column, before: Column) -> Column:
    """The state that a run of rows leaves, given the one before them."""
    return F.when(run.known, run.state).otherwise(before) != (run.flips % 2 == 1)


def quoted_records(spark: SparkSession, files: list[str], sep: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """``(file, at, line, record)``: the records of files whose quoted fields
    hold line breaks, read in splits like any text.

    Every line is a map of the state (inside quotes or not). Its prefix over a
    split's lines gives one map for the split, the prefix over a file's splits
    (a few numbers each) the state that a split starts in, and that the
    state before each line. Lines that start inside a quoted field belong to
    the record before. Lines are shuffled once, by split; only records that
    cross a split's end are put together from two or more.
    """
    lines = _raw_lines(spark, files, encoding)
    opens, keeps = _leaves_open(sep)
    split = ["file", "at"]
    run = _runs_on(F.col("_opens"), F.col("_keeps"), "line", split)
    lines = lines.withColumns({"_opens": opens, "_keeps": keeps}).withColumn("_run", run)
    before = Window.partitionBy(*split).orderBy("line")
    lines = lines.withColumn("_prior", F.lag("_run").over(before)).drop("_opens", "_keeps")

    splits = lines.groupBy(*split).agg(F.max_by("_run", "line").alias("r"))
    # a split's map, as a row's: what it makes of outside and of inside
    maps = splits.select(*split, _after(F.col("r"), F.lit(False)).alias("o"), _after(F.col("r"), F.lit(True)).alias("k"))
    states = maps.withColumn("_all", _runs_on(F.col("o"), F.col("k"), "at", ["file"]))
    start = F.lag(_after(F.col("_all"), F.lit(False))).over(Window.partitionBy("file").orderBy("at"))
    states = states.select(*split, F.coalesce(start, F.lit(False)).alias("_inside"))

    lines = lines.join(states, split)
    inside = F.when(F.col("_prior").isNull(), F.col("_inside")).otherwise(_after(F.col("_prior"), F.col("_inside")))
    lines = lines.withColumn("_first", F.when(~inside, F.col("line")))
    lines = lines.withColumn("_of", F.max("_first").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    parts = lines.groupBy(*split, "_of").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("x"))
    parts = parts.select(*split, "_of", F.array_join(F.col("x.value"), "\n").alias("text"))
    # a split's head without a start of its own goes on with the last record before it
    ends = parts.groupBy(*split).agg(F.max("_of").alias("last"), F.max(F.when(F.col("_of").isNull(), F.col("text"))).alias("head"))
    by_file = Window.partitionBy("file").orderBy("at")
    owner = F.last(F.when(F.col("last").isNotNull(), F.struct("at", "last")), ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    heads = ends.withColumn("o", owner).where(F.col("head").isNotNull() & F.col("o").isNotNull())
    more = heads.groupBy("file", F.col("o.at").alias("at"), F.col("o.last").alias("_of")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "head"))), lambda h: h.head), "\n").alias("more"))
    whole = parts.where(F.col("_of").isNotNull()).join(more, [*split, "_of"], "left")
    text = F.concat_ws("\n", "text", "more")
    return whole.select("file", "at", F.col("_of").alias("line"), F.regexp_replace(text, "\r$", "").alias("record"))


def _with_breaks(spark: SparkSession, files: list[str], sep: str, encoding: str) -> set[str]:
    """The files in which a line leaves a quoted field open."""
    lines = _raw_lines(spark, files, encoding)
    return {r.file for r in lines.where(F.col("value").contains('"') & _leaves_open(sep)[0]).select("file").distinct().collect()}


def _body_records(spark: SparkSession, files: list[str], sep: str, encoding: str, width: int) -> DataFrame:
    """(file, _0 ...): the cells of files with line breaks in quoted fields,
    without each file's first record, its header."""
    records = quoted_records(spark, files, sep, encoding).where(F.trim("record") != "")
    first = records.groupBy("file").agg(F.min(F.struct("at", "line")).alias("h"))
    body = records.join(first, "file").where(F.struct("at", "line") > F.col("h"))
    row = F.from_csv("record", ", ".join(f"_{i} string" for i in range(width)), {**_options(sep), "multiLine": "true"})
    return body.select("file", row.alias("r")).select("file", "r.*")


def _options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _read_records(spark: SparkSession, files: list[str], sep: str, encoding: str) -> DataFrame:
    """Files of one header line with line breaks in quoted fields."""
    names = spark.read.options(header="true", encoding=encoding, **_options(sep)).csv(files[:1]).columns
    return _body_records(spark, files, sep, encoding, len(names)).drop("file").toDF(*names)


def _read_by_position(spark: SparkSession, heads: dict[str, list[str]], encoding: str, broken_of) -> DataFrame:
    """Files of any number of header lines: those of a separator are read
    together by position, and their cells found by each file's own names. Of
    a name that a header repeats, the first column counts."""
    by_sep: dict[str, dict[str, list[str]]] = {}
    for head, files in heads.items():
        sep = _separator(head) or ";"
        names = [clean_header(n) if _separator(head) else n for n in _header_fields(head, sep)]
        for f in files:
            by_sep.setdefault(sep, {})[f] = names
    columns = list(dict.fromkeys(n for files in by_sep.values() for names in files.values() for n in names))
    out = None
    for sep, names_of in by_sep.items():
        width = max(len(n) for n in names_of.values())
        cells = [f"_{i}" for i in range(width)]
        broken = broken_of(list(names_of), sep)
        parts = []
        if plain := [f for f in names_of if f not in broken]:
            # a given schema: each file's header line is left out, whatever it says
            parts.append(spark.read.schema(", ".join(f"{c} string" for c in cells)).options(header="true", encoding=encoding, **_options(sep))
                         .csv(plain).select(F.col("_metadata.file_path").alias("file"), *cells))
        if broken:
            parts.append(_body_records(spark, sorted(broken), sep, encoding, width))
        names = spark.createDataFrame(list(names_of.items()), "of string, names array<string>")
        for part in parts:
            rows = part.join(names, F.col("file") == F.col("of")).select("names", F.array(*cells).alias("cells"))
            at = lambda n: F.array_position("names", F.lit(n)).cast("int")
            rows = rows.select(*[F.when(at(n) > 0, F.get("cells", at(n) - 1)).alias(n) for n in columns])
            out = rows if out is None else out.unionByName(rows)
    return out


def read_bookings_csv(spark: SparkSession, path: str, strict: bool = False,
                      encoding: str = "ISO-8859-1", multiline: bool | None = None) -> DataFrame:
    """All columns as strings, Latin-1, ``"`` quotes; header names lose
    their quotes and blanks (only when a separator was recognised); the words
    for a missing value are NULL.

    Every file is read by its own header line, so files of a folder may have
    other separators or columns; columns meet by name. Quoted fields may hold
    line breaks: a pass over the lines finds the files that have some, and
    those are cut into records by :func:`quoted_records`, in splits as well.
    ``multiline`` saves that pass and takes all files to have some, or none.
    """
    heads = _layouts(spark, path, encoding)
    for head, files in heads.items():
        if _separator(head) is None and strict:
            raise ValueError(f"no separator gives more than 2 columns in {files[0]}")

    def broken_of(files: list[str], sep: str) -> set[str]:
        return _with_breaks(spark, files, sep, encoding) if multiline is None else set(files) if multiline else set()

    out = _read_by_position(spark, heads, encoding, broken_of) if len(heads) > MAX_LAYOUTS else None
    for head, files in heads.items() if out is None else ():
        sep = _separator(head)
        broken = broken_of(files, sep or ";")
        for together in (False, True):
            some = [f for f in files if (f in broken) == together]
            if not some:
                continue
            if together:
                df = _read_records(spark, some, sep or ";", encoding)
            else:
                df = spark.read.options(header="true", encoding=encoding, inferSchema="false", **_options(sep or ";")).csv(some)
            df = df.toDF(*[clean_header(c) for c in df.columns]) if sep else df
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        if strict:
            raise ValueError(f"no separator gives more than 2 columns in {path}")
        return spark.createDataFrame([], "value string")
    missing = [F.when(~F.col(f"`{c}`").isin(MISSING_WORDS), F.col(f"`{c}`")).alias(c) for c in out.columns]
    return out.select(*missing)


def read_planner_bookings(spark: SparkSession, path: str) -> DataFrame:
    """S3: the planner's read: same sniffing, but no separator is an error."""
    return read_bookings_csv(spark, path, strict=True)


# -- S4 / S5: zip + XML -----------------------------------------------------------

_NS_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_NS_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_NS_PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_NS_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _fmt_number(v: str) -> str:
    try:
        f = float(v)
    except ValueError:
        return v
    return str(int(f)) if f.is_integer() and "e" not in v.lower() else v


def xlsx_rows(data: bytes) -> list[list[str | None]]:
    """Rows of the first worksheet as strings (shared, inline and number cells)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in root.iter(f"{_NS_MAIN}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{_NS_MAIN}t")))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    first = next(wb.iter(f"{_NS_MAIN}sheet"))
    rid = first.get(f"{_NS_REL}id")
    target = "worksheets/sheet1.xml"
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        for r in rels.iter(f"{_NS_PKG}Relationship"):
            if r.get("Id") == rid:
                target = r.get("Target")
    path = target.lstrip("/") if target.startswith("/") else "xl/" + target
    sheet = ET.fromstring(z.read(path))
    rows = []
    for row in sheet.iter(f"{_NS_MAIN}row"):
        cells: dict[int, str | None] = {}
        for c in row.iter(f"{_NS_MAIN}c"):
            t = c.get("t")
            v = c.find(f"{_NS_MAIN}v")
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{_NS_MAIN}t"))
            elif v is not None:
                val = v.text if t in ("str", "b", "e") else _fmt_number(v.text or "")
            else:
                val = None
            cells[_col_index(c.get("r"))] = val
        if cells:
            rows.append([cells.get(i) for i in range(max(cells) + 1)])
    return rows


def docx_content(data: bytes) -> tuple[list[list[str]], list[str]]:
    """(table rows of all tables in order, non-blank paragraph texts)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body = ET.fromstring(z.read("word/document.xml"))

    def text_of(el) -> str:
        paras = el.iter(f"{_NS_W}p")
        return "\n".join("".join(t.text or "" for t in p.iter(f"{_NS_W}t")) for p in paras)

    rows = []
    for tbl in body.iter(f"{_NS_W}tbl"):
        for tr in tbl.iter(f"{_NS_W}tr"):
            rows.append([text_of(tc).strip() for tc in tr.iter(f"{_NS_W}tc")])
    paras = ["".join(t.text or "" for t in p.iter(f"{_NS_W}t")) for p in body.iter(f"{_NS_W}p")]
    return rows, [p for p in paras if p.strip()]


_ROWS_SCHEMA = "path string, kind string, row_no long, names array<string>, cells array<string>"


def _names(header: list, width: int) -> list[str]:
    """Column names of a table: its header, ``_i`` for blank or missing ones,
    ``name.k`` for repeats."""
    out: list[str] = []
    for i in range(max(width, len(header))):
        name = str(header[i]) if i < len(header) and header[i] not in (None, "") else f"_{i}"
        again, base = 0, name
        while name in out:
            again += 1
            name = f"{base}.{again}"
        out.append(name)
    return out


def _file_rows(content: bytes, kind: str) -> list[tuple[str, int, list[str], list]]:
    """(kind, row, names, cells) of one file: the first row is the file's own
    header; a document without tables gives its paragraphs."""
    if kind == "xlsx":
        rows, paras = xlsx_rows(content), []
    else:
        rows, paras = docx_content(content)
    if rows:
        names = _names(rows[0], max(map(len, rows)))
        return [("table", i, names[: max(len(r), len(rows[0]))], r) for i, r in enumerate(rows)]
    return [("paragraph", i + 1, ["texto"], [p]) for i, p in enumerate(paras)]


def _explode_files(kind: str):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = [(path, *r) for r in _file_rows(content, kind)]
                yield pd.DataFrame(rows, columns=["path", "kind", "row_no", "names", "cells"])
    return fn


def file_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Long form (path, kind, row_no, names, cells) of every matching file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_explode_files(kind), _ROWS_SCHEMA)


def _to_table(rows: DataFrame) -> DataFrame:
    """One column for every header name of any file, cells put by their own
    file's names."""
    heads = rows.groupBy("path", "kind").agg(F.max_by("names", F.size("names")).alias("names"))
    order = heads.select("path", F.posexplode("names").alias("i", "name")).groupBy("name").agg(F.min(F.struct("i", "path")).alias("first"))
    names = [r.name for r in order.orderBy("first").collect()]
    if not names:
        return rows.sparkSession.createDataFrame([], "value string")
    body = rows.where("row_no > 0")
    cell = F.map_from_arrays(F.slice("names", 1, F.least(F.size("names"), F.size("cells"))),
                             F.slice("cells", 1, F.least(F.size("names"), F.size("cells"))))
    body = body.select(cell.alias("m"))
    return body.select(*[F.try_element_at("m", F.lit(n)).alias(n) for n in names])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook; the first row is the workbook's own
    header, and columns of several workbooks meet by name."""
    return _to_table(file_rows(spark, path, "xlsx"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all tables of each document under its own header (its first
    row); documents without tables give their non-blank paragraphs as column
    ``texto``."""
    return _to_table(file_rows(spark, path, "docx"))


# -- S1 ----------------------------------------------------------------------

READERS = {"csv": read_bookings_csv, "xlsx": read_xlsx, "docx": read_docx}
NOT_BUILT = {"xls": "save legacy workbooks as .xlsx", "pdf": "parse extracted text with text_table_lines"}


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """The reader that the file's suffix names."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix in NOT_BUILT:
        raise NotImplementedError(f".{suffix} is not read here: {NOT_BUILT[suffix]}")
    if suffix not in READERS:
        raise ValueError(f"no reader for {path!r}; there are readers for {', '.join(sorted(READERS))}")
    return READERS[suffix](spark, path)
