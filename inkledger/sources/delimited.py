"""Delimited text with quoted line breaks, read in splits.

A split can't tell by itself whether it begins inside a quoted cell. One pass over the file
finds, for each split, in which state it ends if it begins outside or inside quotes. These
four kinds of splits (always out, always in, same, turned) are combined along the file, one
row per split, and say how each split begins. The second pass cuts every split into records;
the one record that goes on in the next splits is put together from its pieces.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkledger.session import cut_lineage


@dataclass(frozen=True)
class Dialect:
    """How cells are told apart; the defaults are those of a comma-separated file."""

    delimiter: str = ","
    quote: str = '"'
    doubled: bool = True
    initial_space: bool = False

    def reader(self, lines):
        return csv.reader(lines, delimiter=self.delimiter, quotechar=self.quote,
                          doublequote=self.doubled, skipinitialspace=self.initial_space)


def ends_open(line: str, inside: bool, dialect: Dialect) -> bool:
    """Whether a line that begins outside (or inside) quotes ends inside them.

    A quote opens a cell only as its first character; elsewhere outside it is text.
    """
    if dialect.quote not in line:
        return inside
    at = 0
    while True:
        if inside:
            close = line.find(dialect.quote, at)
            if close < 0:
                return True
            at = close + 1
            if dialect.doubled and line.startswith(dialect.quote, at):
                at += 1
                continue
            inside = False
        else:
            if dialect.initial_space:
                while line.startswith(" ", at):
                    at += 1
            if line.startswith(dialect.quote, at):
                inside, at = True, at + 1
                continue
        comma = line.find(dialect.delimiter, at)
        if comma < 0:
            return False
        at = comma + len(dialect.delimiter)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]):
    """(file, block, line) in order; a split's rows come one after the other."""
    for batch in batches:
        yield from zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist())


def _ends(dialect: Dialect):
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, out, in_ = None, False, True
        done = []
        for file, block, line in _by_split(batches):
            if (file, block) != split:
                if split:
                    done.append((*split, out, in_))
                split, out, in_ = (file, block), False, True
            same = out == in_
            out = ends_open(line, out, dialect)
            in_ = out if same else ends_open(line, in_, dialect)
        if split:
            done.append((*split, out, in_))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*done)], names=["file", "block", "if_out", "if_in"])

    return ends


def splits_inside_quotes(lines: DataFrame, dialect: Dialect) -> DataFrame:
    """``file, block`` of the splits that begin inside a quoted cell."""
    splits = lines.mapInArrow(_ends(dialect), "file string, block long, if_out boolean, if_in boolean")
    along = Window.partitionBy("file").orderBy("block")
    until = along.rowsBetween(Window.unboundedPreceding, -1)
    # A split that always ends alike settles the state; those that turn it count from there.
    settled = F.col("if_out") == F.col("if_in")
    turned = splits.withColumn(
        "turns", F.sum((F.col("if_out") & ~F.col("if_in")).cast("int")).over(along))
    last = F.last(F.when(settled, F.struct("if_out", "turns")), ignorenulls=True).over(until)
    before = F.coalesce(F.last("turns").over(until), F.lit(0))
    since = before - F.coalesce(F.col("last.turns"), F.lit(0))
    return turned.withColumn("last", last).withColumn("since", since).filter(
        F.coalesce(F.col("last.if_out"), F.lit(False)) != (F.col("since") % 2 == 1)).select("file", "block")


_PARTS = "file string, block long, at long, part string, cells array<string>"
_PARTS_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()),
                          ("part", pa.string()), ("cells", pa.list_(pa.string()))])


def _fitted(cells: list[str], width: int) -> list[str] | None:
    """Trimmed cells of a row, short ones padded and extra ones dropped; none if all are blank."""
    row = [c.strip() for c in cells[:width]]
    return row + [""] * (width - len(row)) if any(row) else None


def _cut(dialect: Dialect, width: int, inside: dict):
    """Lines to rows of cells; a record that crosses a split's end comes as pieces.

    ``at`` numbers a split's rows without the blank ones. Pieces have ``part``: ``tail`` at the
    end of the split in which the record begins, ``middle`` and ``end`` in those behind it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        rows, size = [], 0
        split, held, open_, carried, at = None, [], False, False, 0

        def close() -> None:
            if held:
                part = "middle" if carried else "tail"
                rows.append((*split, at, part, ["\n".join(held)]))

        for file, block, line in _by_split(batches):
            if (file, block) != split:
                close()
                split, held, at = (file, block), [], 0
                open_ = carried = block in inside.get(file, ())
                if block == 0:
                    line, at = line.removeprefix("﻿"), -1  # the first record is the header
            held.append(line)
            open_ = ends_open(line, open_, dialect)
            if open_:
                continue
            record, held = "\n".join(held), []
            if carried:
                rows.append((*split, -1, "end", [record]))
                carried = False
                continue
            record = record.removesuffix("\r")
            cells = next(dialect.reader(io.StringIO(record, newline="")), [])
            if at < 0:
                at = 0
                continue
            fitted = _fitted(cells, width)
            if fitted:
                rows.append((*split, at, None, fitted))
                at, size = at + 1, size + len(record)
            if len(rows) >= 10_000 or size > 8 << 20:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS_ARROW)], schema=_PARTS_ARROW)
                rows, size = [], 0
        if split:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS_ARROW)], schema=_PARTS_ARROW)

    return cut


def _joined(pieces: DataFrame, dialect: Dialect, width: int) -> DataFrame:
    """Records that cross splits, as the last row of the split in which they begin."""
    along = Window.partitionBy("file").orderBy("block", F.col("part") == "tail").rowsBetween(
        Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("part") == "tail", F.struct("block", "at")), ignorenulls=True).over(along)
    whole = pieces.withColumn("owner", owner).groupBy("file", "owner").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("block", (F.col("part") == "tail").alias("last"), "cells"))),
        lambda p: p["cells"][0]), "\n").alias("record"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            rows = []
            for file, block, at, record in zip(*(c.to_pylist() for c in batch.columns)):
                record = record.removesuffix("\r")
                fitted = _fitted(next(dialect.reader(io.StringIO(record, newline="")), []), width)
                if at >= 0 and fitted:
                    rows.append((file, block, at, None, fitted))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS_ARROW)], schema=_PARTS_ARROW)

    return whole.select("file", "owner.block", "owner.at", "record").mapInArrow(parse, _PARTS)


def read_records(spark: SparkSession, path: str, headers: list[str], dialect: Dialect,
                 whole_folder: bool = False, first: int = 2) -> DataFrame:
    """Rows of one or many delimited files as text columns, with ``import_row`` and ``source_path``.

    The first record of each file is its header and left out. Short rows are padded, extra
    cells dropped, rows without any value left out. ``import_row`` counts what is kept of a
    file from ``first``; with ``whole_folder`` the files of a folder are the parts of one manifest,
    counted through in the order of their names. A quoted cell may hold line breaks anywhere,
    also where the file is split; one that is never closed takes in the rest of its file.

    The driver holds the start of each split that begins inside quotes, one per split at most.
    """
    lines = _lines(spark, path)
    inside: dict[str, set[int]] = {}
    for r in splits_inside_quotes(lines, dialect).collect():
        inside.setdefault(r["file"], set()).add(r["block"])
    # Written, as rows are read for their numbers and then by every later step.
    parts = cut_lineage(lines.mapInArrow(_cut(dialect, len(headers), inside), _PARTS))
    rows = parts.filter("part is null")
    if inside:
        pieces = parts.filter("part is not null")
        rows = rows.unionByName(_joined(pieces, dialect, len(headers)))
    rows = rows.drop("part")
    folder = F.regexp_replace("file", "[^/]*$", "") if whole_folder else F.col("file")
    before = Window.partitionBy("of").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("of", folder).select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["file", "block"]).select(
        *[F.col("cells")[i].alias(h) for i, h in enumerate(headers)],
        (F.col("start") + F.col("at") + first).alias("import_row"), F.col("file").alias("source_path"))
