"""Line dedup of review notes: chunks with content-defined boundaries, repeated across notes.

Every line is hashed; a rolling hash over the last line hashes decides where a chunk ends, so
a passage is cut the same way wherever it stands. A chunk's ends may still depend on the lines
around it, so each two neighbouring lines are matched as well: whatever passage of two or more
lines an earlier note holds, all of its lines go.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkledger.session import cut_lineage

# A boundary falls after a line when the rolling hash's last four bits are below this.
BOUNDARY_OF_16 = 12
ROLLING_LINES = 2
# A chunk never has more lines.
MOST_LINES = 8
# Removed are runs of at least this many lines with words, and single lines of more words.
LEAST_LINES = 2
LONG_WORDS = 50
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunk_lines(note: str) -> list[tuple[int, list[str]]]:
    """(first line, lines) of every chunk."""
    out: list[tuple[int, list[str]]] = []
    held: list[str] = []
    recent: list[int] = []
    first = 0
    for number, line in enumerate(note.split("\n")):
        held.append(line)
        recent = [*recent[-(ROLLING_LINES - 1):], xxhash.xxh64_intdigest(line.encode())]
        rolling = 0
        for h in recent:
            rolling = (rolling * _BASE + h) & _MASK
        if (rolling >> 33) % 16 < BOUNDARY_OF_16 or len(held) == MOST_LINES:
            out.append((first, held))
            held, first = [], number + 1
    if held:
        out.append((first, held))
    return out


def _units(note: str) -> Iterator[tuple[str, int, int]]:
    """(text, first line, last line) of each chunk, two neighbouring lines and long line.

    Blank lines between two lines do not part them. A chunk of one line that is not long says
    nothing of the lines beside it, so it is no unit: two such, each from another note, would
    add up to a passage that no note holds.
    """
    for first, lines in chunk_lines(note):
        if sum(1 for line in lines if line.strip()) >= LEAST_LINES:
            yield "\n".join(lines), first, first + len(lines) - 1
    before = None
    for number, line in enumerate(note.split("\n")):
        if not line.strip():
            continue
        if before is not None:
            yield f"{before[1]}\n{line}", before[0], number
        if len(line.split()) > LONG_WORDS:
            yield line, number, number
        before = number, line


_MARKS = "position long, note_id long, hash long, more long, first int, last int"
_LEFT = ("text string, removed_lines int, removed_spans array<array<int>>, "
         "units array<struct<hash: bigint, more: bigint, first: int, last: int, unit: string>>")


def _marks(batches: Iterator[pa.RecordBatch], digest) -> Iterator[pa.RecordBatch]:
    """Where every unit lies, named by 128 bits of hash."""
    for whole in batches:
        for at in range(0, len(whole), 2000):
            batch = whole.slice(at, 2000)
            owner, hashes, first, last = [], [], [], []
            for number, note in enumerate(batch[2].to_pylist()):
                for text, a, b in _units(note or ""):
                    owner.append(number)
                    hashes.append(digest(text.encode()))
                    first.append(a)
                    last.append(b)
            words = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            rows = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch[0].take(rows), batch[1].take(rows), pa.array(words[:, 0]), pa.array(words[:, 1]),
                 pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                names=[c.split()[0] for c in _MARKS.split(", ")])


def _repeated(units: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the keeper of what several notes hold: the least position."""
    return units.groupBy(*by).agg(
        F.min("position").alias("keeper"), F.max("position").alias("_last"),
        F.max(F.col("position").isNull()).alias("_null"),
    ).filter((F.col("keeper") < F.col("_last")) | (F.col("keeper").isNotNull() & F.col("_null"))).select(*by, "keeper")


def _without(note: str, marks: list[dict], least: int) -> tuple[str, list[list[int]]]:
    """A note without the marked lines that form runs of enough lines or hold a long one, and the runs."""
    lines = note.split("\n")
    marked = [False] * len(lines)
    for m in marks:
        for i in range(m["first"], m["last"] + 1):
            marked[i] = True
    runs, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and (marked[j] or (j > i and not lines[j].strip())):
            j += 1
        worded = [x for x in lines[i:j] if x.strip()]
        if len(worded) >= least or any(len(x.split()) > LONG_WORDS for x in worded):
            runs.append([i, j])
        i = max(j, i + 1)
    drop = {i for a, b in runs for i in range(a, b)}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), runs


def _marked_units(note: str, marks: list[dict], digest) -> list[dict]:
    """The marked units with their texts."""
    names = {(m["first"], m["last"]): [] for m in marks}
    for m in marks:  # two units may lie alike, one with blank lines and one without
        names[m["first"], m["last"]].append((m["hash"], m["more"]))
    out = []
    for text, a, b in _units(note):
        if (a, b) in names and (name := struct.unpack("=2q", digest(text.encode()))) in names[a, b]:
            out.append({"hash": name[0], "more": name[1], "first": a, "last": b, "unit": text})
    return out


def _strip(batches: Iterator[pa.RecordBatch], least: int, digest=None) -> Iterator[pa.RecordBatch]:
    """Notes without what is marked as held before and, by ``digest``, the texts of all marked units."""
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("more", pa.int64()), ("first", pa.int32()),
                               ("last", pa.int32()), ("unit", pa.string())]))
    for whole in batches:
        for at in range(0, len(whole), 1000):
            batch = whole.slice(at, 1000)
            texts, gone, spans, units = [], [], [], []
            for note, marks in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                again = [m for m in marks or () if m["again"]]
                text, runs = _without(note, again, least) if again else (note, [])
                texts.append(text)
                gone.append(sum(b - a for a, b in runs))
                spans.append(runs)
                units.append(_marked_units(note, marks, digest) if marks and digest else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), pa.array(gone, pa.int32()),
                 pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(units, kind), *batch.columns[2:]],
                names=["text", "removed_lines", "removed_spans", "units", *batch.schema.names[2:]])


def drop_repeated_lines(
    records: DataFrame, position: str = "position", notes: str = "notes", least: int = LEAST_LINES,
    digest=xxhash.xxh3_128_digest,
) -> DataFrame:
    """Remove runs of lines that an earlier review note holds as well.

    Of the notes that share a chunk or two neighbouring lines, the one with the least position
    keeps them; so a whole passage goes, whatever stands around it. The others lose them if at
    least ``least`` lines with words go in one run, or a line of over LONG_WORDS words does;
    blank lines inside and after a run go with it. Every two lines that go together stand together
    in an earlier note; lines that only occur apart from each other stay. The 128 bits of ``digest`` only say what may be
    equal; those chunks and lines are then compared byte by byte, and where bytes differ, they decide.

    Returns all other columns in ``_row``, text (the note that is left), removed_lines and
    removed_spans (pairs of first line and end). Null and empty notes stay as they are; rows
    equal in position and note count as one note and are all returned; a null position comes
    after all others. A repeat inside one note is not this operator's matter.
    """
    rows = records.select(
        F.struct(*[c for c in records.columns if c != notes]).alias("_row"),
        F.col(position).cast("long").alias("position"),
        F.col(notes).cast("string").alias("notes"),
    ).withColumn("note_id", F.xxhash64("position", "notes"))
    units = cut_lineage(rows.select("position", "note_id", "notes").mapInArrow(
        lambda batches: _marks(batches, digest), _MARKS))
    name = ["hash", "more"]
    alike = units.join(_repeated(units, name), name).withColumn("again", ~F.col("position").eqNullSafe(F.col("keeper")))
    mark = F.struct(*name, "first", "last", "again")

    def stripped(marked: DataFrame, digest=None) -> DataFrame:
        # A note's marks are bounded by its own lines; its id covers position and text.
        marks = marked.groupBy("note_id").agg(F.collect_set(mark).alias("marks"))
        joined = rows.join(marks, "note_id", "left").select("notes", "marks", "position", "note_id", "_row")
        schema = T.StructType([
            *T.StructType.fromDDL(_LEFT).fields, *(joined.schema[c] for c in ("position", "note_id", "_row"))])
        return joined.mapInArrow(lambda b: _strip(b, least, digest), schema)

    # The notes are written once with what hashes mark taken out, and the marked units beside them.
    left = cut_lineage(stripped(alike, digest), compression="zstd")
    out = ("text", "removed_lines", "removed_spans", "_row")
    texts = left.select("position", "note_id", F.explode("units").alias("unit")).select("position", "note_id", "unit.*")
    unlike = cut_lineage(texts.groupBy(*name).agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
                         .filter("low < high").select(*name))
    if unlike.isEmpty():
        return left.select(*out)
    # Hashes agree where bytes differ: there the units' texts say what is held before.
    told = texts.join(unlike, name, "left_semi")
    by_text = told.join(_repeated(told, [*name, "unit"]), [*name, "unit"]).withColumn(
        "again", ~F.col("position").eqNullSafe(F.col("keeper")))
    columns = ["note_id", *name, "first", "last", "again"]
    marked = alike.join(unlike, name, "left_anti").select(*columns).unionByName(by_text.select(*columns))
    return stripped(marked.filter("again")).select(*out)
