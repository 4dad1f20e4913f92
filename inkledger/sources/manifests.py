"""Manifest readers: identifier lists, delimited text and workbooks."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkledger.functions import text as tx
from inkledger.operators.manifest import ManifestError, number_rows
from inkledger.session import cut_lineage
from inkledger.sources import delimited
from inkledger.vocabulary import ROLE_ALIASES

DELIMITERS = ",\t;|"
# The dialect is guessed from so much text; the header is always read whole.
SAMPLE_BYTES = 65536
csv.field_size_limit(1 << 30)


def unique_headers(values: list[object]) -> list[str]:
    """Blank headers become ``column_n``; repeats (case ignored) get ``_2``, ``_3`` …"""
    names: list[str] = []
    for n, value in enumerate(values, start=1):
        base = str(value if value is not None else "").strip() or f"column_{n}"
        taken = {name.lower() for name in names}
        tries = (base if k == 1 else f"{base}_{k}" for k in range(1, len(values) + 2))
        names.append(next(name for name in tries if name.lower() not in taken))
    return names


def _drop_blank_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.filter(F.concat_ws("", *[F.col(f"`{c}`") for c in columns]) != "")


def read_identifier_list(spark: SparkSession, path: str, whole_folder: bool = False) -> DataFrame:
    """One identifier per non-blank line; the column is ``input_value``.

    Rows count per file, or with ``whole_folder`` through the files of a folder in name order.
    """
    lines = spark.read.text(path).select("*", "_metadata")
    kept = lines.withColumn("input_value", tx.strip("value")).filter("input_value <> ''").drop("value")
    return number_rows(kept, whole_folder=whole_folder).drop("_metadata")


def _head(spark: SparkSession, path: str) -> tuple[str, str]:
    """First lines of one file and its whole header record, however long that is."""
    lines, asked = spark.read.text(path), 64
    while True:
        rows = [r["value"] for r in lines.take(asked)]
        if not rows:
            raise ManifestError("the selected file is empty")
        quotes, end = 0, None
        for n, row in enumerate(rows):
            quotes += row.count('"')
            if quotes % 2 == 0:
                end = n + 1
                break
        if end is not None or len(rows) < asked:
            text = "\n".join(rows).lstrip("\ufeff")
            return text[:SAMPLE_BYTES], "\n".join(rows[:end]).lstrip("\ufeff")
        asked *= 4  # the record goes on behind these lines


def sniff(sample: str, path: str) -> delimited.Dialect:
    """Dialect of a sample; where it is undecided, tab for .tsv and comma otherwise."""
    try:
        found = csv.Sniffer().sniff(sample, delimiters=DELIMITERS)
    except csv.Error:
        return delimited.Dialect("\t" if path.lower().endswith(".tsv") else ",")
    # A sample without a doubled quote doesn't say that none will come.
    return delimited.Dialect(found.delimiter, found.quotechar or '"', True, found.skipinitialspace)


def read_delimited(spark: SparkSession, path: str, whole_folder: bool = False) -> DataFrame:
    """All-text manifest with cleaned headers; short rows padded, extra cells dropped.

    Files are read in splits, quoted line breaks or not (``delimited.read_records``). All files
    of ``path`` have the header of the first; ``whole_folder`` counts their rows through as the parts
    of one manifest.
    """
    sample, header = _head(spark, path)
    if not sample.strip():
        raise ManifestError("the selected file is empty")
    dialect = sniff(sample, path)
    headers = unique_headers(next(dialect.reader(io.StringIO(header, newline=""))))
    return delimited.read_records(spark, path, headers, dialect, whole_folder)


# ----------------------------------------------------------------------- workbooks

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value = cell.get("t", "n"), cell.findtext("m:v", "", _NS)
    if kind == "s":
        return shared[int(value)].strip()
    if kind == "inlineStr":
        return "".join(cell.itertext()).strip()
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and value:
        number = float(value)
        return str(int(number)) if number.is_integer() else repr(number)
    return value.strip()


def workbook_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet number, sheet name, row number, cells) of one workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            items = ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)
            shared = ["".join(part.text or "" for part in item.iter(f"{{{_NS['m']}}}t")) for item in items]
        links = {
            r.get("Id"): r.get("Target")
            for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        }
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
        for sheet_no, sheet in enumerate(sheets):
            target = posixpath.normpath(posixpath.join("/xl", links[sheet.get(_REL)])).lstrip("/")
            with book.open(target) as stream:
                for row_no, (_, row) in enumerate(
                    (e for e in ElementTree.iterparse(stream) if e[1].tag.endswith("}row")), start=1
                ):
                    cells: list[str] = []
                    for cell in row.findall("m:c", _NS):
                        at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [""] * (at - len(cells)) + [_cell_text(cell, shared)]
                    yield sheet_no, sheet.get("name", ""), int(row.get("r", row_no)), cells
                    row.clear()


def read_workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of many workbooks at once: ``path, sheet_no, sheet, row_no, cells``."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"]):
                rows = [(source, *row) for row in workbook_rows(content)]
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at:at + 10_000], columns=["path", "sheet_no", "sheet", "row_no", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(
        parse, "path string, sheet_no int, sheet string, row_no int, cells array<string>"
    )


def pick_manifest_sheet(cells: DataFrame) -> DataFrame:
    """Per workbook the first sheet with an identifier header, else the first with any row."""
    aliases = [tx.header_key_of(a) for a in ROLE_ALIASES["identifier"]]
    first_row = Window.partitionBy("path", "sheet_no").orderBy("row_no")
    headers = cells.withColumn("_k", F.row_number().over(first_row)).filter("_k = 1")
    has_alias = F.exists("cells", lambda h: tx.header_key(h).isin(*aliases))
    best = headers.groupBy("path").agg(
        F.min(F.struct((~has_alias).alias("no_alias"), F.col("sheet_no"), F.col("row_no"), F.col("cells"))).alias("b")
    ).select("path", F.col("b.sheet_no").alias("sheet_no"), F.col("b.row_no").alias("header_row"), F.col("b.cells").alias("headers"))
    return cells.join(best, ["path", "sheet_no"]).filter("row_no > header_row")


def _clean_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["headers"] = [unique_headers(list(h)) for h in batch["headers"]]
        yield batch


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The manifest sheets of one workbook, or of all in a folder, as one table.

    Every workbook has headers of its own. The table has a column for each name (case ignored)
    that any of them has, spelled and ordered as first seen by path; workbooks without it are
    blank there. ``import_row`` counts the kept rows of each workbook from 2. To the driver come
    the column names only.
    """
    cells = cut_lineage(read_workbook_cells(spark, path))
    body = cut_lineage(pick_manifest_sheet(cells))
    heads = cut_lineage(body.groupBy("path").agg(F.first("headers").alias("headers")).mapInPandas(
        _clean_headers, "path string, headers array<string>"))
    named = heads.select("path", F.posexplode("headers").alias("at", "name"))
    first = named.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("path", "at", "name")).alias("f"))
    headers = [r["name"] for r in first.orderBy("f.path", "f.at").select("f.name").collect()]
    if not headers:
        raise ManifestError("the selected workbook contains no non-empty worksheet")
    placed = body.drop("headers").join(
        heads.select("path", F.transform("headers", F.lower).alias("_keys")), "path")
    table = placed.select(
        F.col("path").alias("source_path"), "row_no",
        *[F.coalesce(F.get("cells", F.array_position("_keys", F.lower(F.lit(h))).cast("int") - 1), F.lit("")).alias(h)
          for h in headers],
    )
    kept = _drop_blank_rows(table, headers)
    # One sheet holds at most 1,048,576 rows, so a window per workbook is bounded.
    numbered = Window.partitionBy("source_path").orderBy("row_no")
    return kept.select(
        *[F.col(f"`{h}`") for h in headers],
        (F.row_number().over(numbered) + 1).cast("long").alias("import_row"), "source_path",
    )


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Any supported manifest by file suffix."""
    suffix = posixpath.splitext(path.lower())[1]
    if suffix == ".txt":
        return read_identifier_list(spark, path)
    if suffix in (".csv", ".tsv"):
        return read_delimited(spark, path)
    if suffix == ".xlsx":
        return read_workbook(spark, path)
    raise ManifestError("supported list formats are .txt, .csv, .tsv and .xlsx")
