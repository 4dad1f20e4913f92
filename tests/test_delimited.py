"""Delimited text in splits, against reading the whole file with the csv module."""

from __future__ import annotations

import csv
import io
import random

import pytest

from inkledger.sources import manifests
from inkledger.sources.delimited import Dialect, ends_open, read_records


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("300", "1", "64")):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plain(text, width, dialect=Dialect()):
    rows = list(dialect.reader(io.StringIO(text.removeprefix("﻿"), newline="")))[1:]
    fitted = [([c.strip() for c in r[:width]] + [""] * width)[:width] for r in rows]
    return [(*r, i + 2) for i, r in enumerate(r for r in fitted if any(r))]


def table_of(rows):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


def found(spark, path, names, dialect=Dialect()):
    got = read_records(spark, str(path), names, dialect).drop("source_path")
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[-1])


def random_table(seed):
    draw = random.Random(seed)
    words = ["worn", 'a "quoted" word', "x,y", "", "line\nbreak", "two\n\nbreaks", '"', "é\r\nü", "  ", "\n" * 40]
    long = "very long\n" * 120
    return [["UWI", "COMMENT", "TIFPATH"]] + [
        [str(i) if draw.random() < 0.9 else "", long if draw.random() < 0.03 else draw.choice(words), draw.choice(words)]
        for i in range(250)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_quoted_tables(spark, small_splits, tmp_path, seed):
    path, names = tmp_path / "m.csv", ["UWI", "COMMENT", "TIFPATH"]
    text = table_of(random_table(seed))
    path.write_text("﻿" + text, newline="")
    lines = spark.read.text(str(path)).rdd.getNumPartitions()
    assert lines > 20  # the file is split
    assert found(spark, path, names) == plain(text, 3)


def test_quotes_inside_unquoted_cells(spark, small_splits, tmp_path):
    """A quote that doesn't open its cell is text: 8" is no open cell."""
    rows = "".join(f'{i},8" casing,"a ""b"",\nc"\n' for i in range(200))
    path = tmp_path / "m.csv"
    path.write_text("A,B,C\n" + rows)
    assert found(spark, path, ["A", "B", "C"]) == plain("A,B,C\n" + rows, 3)
    assert len(plain("A,B,C\n" + rows, 3)) == 200


def test_header_over_splits_and_unclosed_cell(spark, small_splits, tmp_path):
    text = 'A,"long\n' + "header\n" * 200 + '",C\n1,2,3\n4,"never closed\n' + "rest,of,file\n" * 100
    path = tmp_path / "m.csv"
    path.write_text(text)
    assert found(spark, path, ["A", "B", "C"]) == plain(text, 3)


def test_dialects(spark, small_splits, tmp_path):
    for n, dialect in enumerate([Dialect(";", "'"), Dialect("\t"), Dialect(",", '"', True, True)]):
        q, d = dialect.quote, dialect.delimiter
        gap = " " if dialect.initial_space else ""
        text = f"A{d}B\n" + "".join(f"{i}{d}{gap}{q}a{q}{q}b{d}\nc{q}\n" for i in range(100))
        path = tmp_path / f"m{n}.csv"
        path.write_text(text)
        assert found(spark, path, ["A", "B"], dialect) == plain(text, 2, dialect)


def test_windows_line_ends_and_empty_files(spark, small_splits, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("A,B\r\n" + '1,"x\r\ny"\r\n2,z\r\n' * 90, newline="")
    assert found(spark, path, ["A", "B"]) == plain("A,B\r\n" + '1,"x\r\ny"\r\n2,z\r\n' * 90, 2)
    (tmp_path / "h.csv").write_text("A,B\n")
    assert found(spark, tmp_path / "h.csv", ["A", "B"]) == []
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(manifests.ManifestError):
        manifests.read_delimited(spark, str(tmp_path / "e.csv"))


def test_parts_of_one_manifest(spark, small_splits, tmp_path):
    """Rows count through the parts of a folder by name, or start anew in each file."""
    wanted = []
    for part in range(3):
        rows = [[f"{part}{i}", "a\nb" * (i % 5)] for i in range(60)]
        (tmp_path / f"part-0000{part}.csv").write_text(table_of([["UWI", "COMMENT"], *rows, ["", " "]]))
        wanted += rows
    (tmp_path / "part-00003.csv").write_text("UWI,COMMENT\n")
    whole = manifests.read_delimited(spark, str(tmp_path), whole_folder=True)
    assert sorted((r["import_row"], r["UWI"], r["COMMENT"]) for r in whole.collect()) == [
        (i + 2, *r) for i, r in enumerate(wanted)]
    each = manifests.read_delimited(spark, str(tmp_path))
    assert sorted(r["import_row"] for r in each.collect()) == sorted(list(range(2, 62)) * 3)
    for part in range(3):
        (tmp_path / f"ids{part}.txt").write_text("".join(f" {part}{i}\n\n" for i in range(50)))
    ids = manifests.read_identifier_list(spark, str(tmp_path / "ids*.txt"), whole_folder=True)
    assert sorted((r["import_row"], r["input_value"]) for r in ids.collect()) == [
        (n + 2, f"{n // 50}{n % 50}") for n in range(150)]


def test_line_states():
    d = Dialect()
    cases = [('a,b', False, True), ('"a', True, False), ('a"b', False, False), ('a,"b""', True, False),
             ('""', False, True), ('b",c', False, False), ('b"",c', False, True), ('x",y,"z', True, True)]
    for line, out, in_ in cases:
        assert (ends_open(line, False, d), ends_open(line, True, d)) == (out, in_), line
