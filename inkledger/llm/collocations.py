"""Phrases that belong together in review notes, from count streams merged in sorted order.

The layout follows streaming estimation of phrase tables. The notes give one stream of
windows (a word and the words after it), counted per task and sorted. In that prefix order
every phrase is a run of rows, and the runs of the shorter phrases it begins with enclose it,
so one walk gives each phrase its count, the counts of its beginnings and the largest count
of a phrase that goes on to the right. The phrases that are frequent enough are then sorted
by their words from the last to the first. In that suffix order a second walk gives the
counts of their ends and the largest count of a phrase that begins further left. Neither
walk looks anything up by hash.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.llm.store import partitions_for
from inkledger.session import cut_lineage

# Words a task counts before it passes its counts on.
HELD_WORDS = 800_000
# Rows of one batch that a task passes on.
SENT_ROWS = 20_000
# Bytes of notes per range of the prefix order, and phrases per range of the suffix order.
RANGE_BYTES = 4 << 20
RANGE_PHRASES = 500_000
# Windows per range that set the bounds of the ranges, from so many notes at most.
BOUND_ROWS, BOUND_NOTES = 20, 4000

_STOP = b"\xff"  # no byte of a text
_LETTERS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ENDS = b".,;:!?\n\x0b\x0c\r"
_SHAPE = bytes.maketrans(_LETTERS[0] + _ENDS + b"\t", _LETTERS[1] + _STOP * len(_ENDS) + b" ")


class _Vocabulary(dict):
    """Word -> number, in the order of first sight; a stop is -1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def _names(width: int) -> list[str]:
    return [f"w{k}" for k in range(1, width + 1)]


def _schema(width: int, extra: list[tuple[str, pa.DataType]]) -> pa.Schema:
    words = [(w, pa.string()) for w in _names(width)]
    return pa.schema([("kind", pa.string()), *words, ("n", pa.int64()), *extra])


def _counted(held: dict[str, list[np.ndarray]], place: np.ndarray, width: int):
    """Per kind: the places (-1: none) of its different windows in ascending order, counts."""
    for kind in sorted(held):
        ids = place[np.concatenate([*held[kind], np.full(width, -1, np.int32)])]
        at = np.flatnonzero(ids[:len(ids) - width + 1] >= 0)
        columns = [ids[at]]
        for k in range(1, width):
            columns.append(np.where(columns[-1] < 0, np.int32(-1), ids[at + k]))
        del ids, at
        rank, size = columns[0].astype(np.int64) + 1, len(place)
        for column in columns[1:]:
            if int(rank.max(initial=0)) + 1 > (1 << 62) // size:
                rank = np.unique(rank, return_inverse=True)[1]
            rank = rank * size + column + 1
        _, first, counts = np.unique(rank, return_index=True, return_counts=True)
        yield kind, [c[first] for c in columns], counts


def _window_counter(width: int, bounds: list[tuple]):
    """Notes to sorted counts of windows, each with the number of its range."""
    schema = _schema(width, [("range", pa.int32())])

    def flush(held: dict, vocabulary: _Vocabulary) -> Iterator[pa.RecordBatch]:
        words = sorted(w for w in vocabulary if w != _STOP)
        # Of a word's number in the sorted words; -1 stays.
        place = np.full(len(words) + 1, -1, np.int32)
        place[[vocabulary[w] for w in words]] = np.arange(len(words))
        known = pa.array(words, pa.binary()).cast(pa.string())
        for kind, columns, counts in _counted(held, place, width):

            def key(i: int, kind=kind, columns=columns) -> tuple:
                return kind.encode(), *(words[c[i]] if c[i] >= 0 else b"" for c in columns)

            edges = [bisect.bisect_left(range(len(counts)), b, key=key) for b in bounds]
            spread = np.searchsorted(np.array(edges, np.int64), np.arange(len(counts)), side="right")
            for low in range(0, len(counts), SENT_ROWS):
                part = slice(low, low + SENT_ROWS)
                taken = [known.take(pa.array(c[part], mask=c[part] < 0)) for c in columns]
                size = len(counts[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(kind, pa.string()), size), *taken, pa.array(counts[part]),
                     pa.array(spread[part], pa.int32())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, n_words = _Vocabulary({_STOP: -1}), defaultdict(list), 0
        for batch in batches:
            notes, waiting, size = defaultdict(list), 0, len(batch)
            texts = batch[1].cast(pa.binary())
            for i, kind in enumerate(batch[0].to_pylist()):
                note = texts[i].as_py()
                notes[kind].append(note)
                waiting += len(note)
                if waiting < 1 << 20 and i < size - 1:
                    continue
                for k, own in notes.items():
                    shaped = _STOP.join(own).translate(_SHAPE)
                    words = shaped.replace(_STOP, b" " + _STOP + b" ").split()
                    ids = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
                    held[k] += [ids, np.full(1, -1, np.int32)]
                    n_words += len(ids)
                notes, waiting = defaultdict(list), 0
                if n_words >= HELD_WORDS:
                    yield from flush(held, vocabulary)
                    pa.default_memory_pool().release_unused()
                    vocabulary, held, n_words = _Vocabulary({_STOP: -1}), defaultdict(list), 0
        if n_words:
            yield from flush(held, vocabulary)

    return count


def _differs(column: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before it; nulls are equal."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return unequal | (there[1:] != there[:-1])


def _walker(width: int, floor: int, own_rows: bool, carried: list[tuple[str, pa.DataType]]):
    """Walk over one sorted range, all lengths in lockstep.

    A phrase is a run of rows that begin with its words. Its count is the sum over the run, or
    with ``own_rows`` the count of the row that holds nothing else. Runs at either end of the
    range may go on in the next: they come out as ``open`` with what this range knows, and
    phrases that begin like them have null in ``shorter``. A range holds a bounded number of
    rows, and all that is kept besides are numbers per row.
    """
    schema = _schema(width, [("shorter", pa.list_(pa.int64())), ("longer", pa.int64()),
                             ("open", pa.bool_()), *carried])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        column = {c: pa.concat_arrays([b.column(c) for b in parts]) for c in parts[0].schema.names}
        n = column["n"].to_numpy()
        changed = np.r_[True, _differs(column["kind"])]
        there = [np.ones(len(n), bool)]
        runs = [(np.flatnonzero(changed), np.cumsum(changed) - 1)]
        for w in _names(width):
            changed = changed | np.r_[True, _differs(column[w])]
            runs.append((np.flatnonzero(changed), np.cumsum(changed) - 1))
            there.append(column[w].is_valid().to_numpy(zero_copy_only=False))
        depth = np.sum(there, axis=0) - 1
        totals, opens = [], []
        for k, (start, _) in enumerate(runs):
            counts = there[k] & (depth == k) if own_rows else there[k]
            totals.append(np.add.reduceat(np.where(counts, n, 0), start))
            opens.append(np.isin(np.arange(len(start)), (0, len(start) - 1)))
        for k, (start, _) in enumerate(runs):
            if own_rows and k == 0:
                continue
            longer = np.zeros(len(start), np.int64)
            if 0 < k < width:
                child, settled = runs[k + 1][0], ~opens[k + 1] & (totals[k + 1] >= floor)
                settled &= there[k + 1][child]
                np.maximum.at(longer, runs[k][1][child[settled]], totals[k + 1][settled])
            kept = there[k][start] & (opens[k] | (totals[k] >= floor) | (k == 0))
            at = start[kept]
            if not len(at):
                continue
            shorter = np.zeros((len(at), max(k - 1, 0)), np.int64)
            unknown = np.zeros(shorter.shape, bool)
            for j in range(1, k):
                run = runs[j][1][at]
                shorter[:, j - 1], unknown[:, j - 1] = totals[j][run], opens[j][run]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(at) + 1) * shorter.shape[1], pa.int32()),
                pa.array(shorter.ravel(), mask=unknown.ravel()))
            rows = pa.array(at)
            words = [column[w].take(rows) if j < k else pa.nulls(len(at), pa.string())
                     for j, w in enumerate(_names(width))]
            elsewhere = depth[at] != k
            own = [column[c].take(pa.array(at, mask=elsewhere)) for c, _ in carried]
            yield pa.RecordBatch.from_arrays(
                [column["kind"].take(rows), *words, pa.array(totals[k][kept]), lists,
                 pa.array(longer[kept]), pa.array(opens[k][kept]), *own], schema=schema)

    return walk


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean",
             pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _phrase(width: int) -> Column:
    return F.array_compact(F.array(*_names(width)))


def _joined_runs(walked: DataFrame, width: int, floor: int, carried: list[str]) -> DataFrame:
    """Put the runs together that several ranges hold, and give their counts to the rest.

    There are at most ``2 * width`` open runs a range, so what is joined here has a few rows per
    task, and the adaptive planner broadcasts it while it is small.
    """
    names, keys = _names(width), ["kind", *_names(width)]
    totals = walked.filter("open").groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("longer").alias("longer"),
        *[F.max(c).alias(c) for c in carried]).withColumn("words", _phrase(width))
    totals = cut_lineage(totals)
    stem = F.slice("words", 1, F.size("words") - 1)
    grown = totals.filter((F.col("n") >= floor) & (F.size("words") > 1)).groupBy(
        "kind", stem.alias("words")).agg(F.max("n").alias("_grown"))
    joined = totals.join(grown, ["kind", "words"], "left").withColumns({
        "longer": F.greatest("longer", F.coalesce("_grown", F.lit(0))),
        "shorter": F.array_repeat(F.lit(None).cast("long"), F.size("words") - 1),
    }).drop("_grown", "words")
    lacks = F.exists("shorter", lambda x: x.isNull())
    pending = walked.filter(~F.col("open") & lacks).drop("open").unionByName(joined)
    for j in range(1, width):
        known = totals.filter(F.size("words") == j).select(
            "kind", *names[:j], F.col("n").alias("_known"))
        pending = pending.join(known, ["kind", *names[:j]], "left").withColumn(
            "shorter", F.transform("shorter", lambda x, i: F.when(
                i == j - 1, F.coalesce(x, F.col("_known"))).otherwise(x))).drop("_known")
    done = walked.filter(~F.col("open") & ~lacks).drop("open")
    return done.unionByName(pending).filter(F.col("n") >= floor)


def _bounds(notes: DataFrame, n_notes: int, ranges: int, width: int) -> list[tuple]:
    """Points that cut the prefix order into ranges, from some notes; they only set sizes."""
    if ranges < 2:
        return []
    some = notes.sample(min(1.0, BOUND_NOTES / max(1, n_notes)), seed=11)
    schema = _schema(width, [("range", pa.int32())])
    heads = some.mapInArrow(_window_counter(width, []), _ddl(schema)).select(
        "kind", *[F.substring(w, 1, 32).alias(w) for w in _names(width)])
    picked = heads.orderBy(F.xxhash64(*heads.columns), *heads.columns).limit(BOUND_ROWS * ranges)
    points = sorted(tuple((x or "").encode() for x in row) for row in picked.collect())
    return sorted({points[len(points) * r // ranges] for r in range(1, ranges)}) if points else []


def phrase_counts(
    records: DataFrame, kind: str = "stamp_type", notes: str = "notes", min_count: int = 10,
    max_words: int = 3, unknown: str = "", range_bytes: int = RANGE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``max_words`` words with their parts' counts, and words per kind.

    The first table has ``kind``, ``words`` (array), ``n``, ``starts`` (counts of the first 1,
    2, ... words), ``ends`` (counts of the last 1, 2, ... words) and ``longer`` (largest count
    of a frequent phrase of one more word that holds it); the second ``kind`` and ``n_words``.
    """
    width = max_words
    rows = records.select(
        F.coalesce(F.col(f"`{kind}`").cast("string"), F.lit(unknown)).alias("kind"),
        F.coalesce(F.col(f"`{notes}`").cast("string"), F.lit("")).alias("notes"))
    size = rows.agg(F.sum(F.octet_length("notes")), F.count("*")).first()
    ranges = partitions_for(records.sparkSession, size[0] or 0, range_bytes)
    bounds = _bounds(rows, size[1], ranges, width)
    windows = rows.mapInArrow(
        _window_counter(width, bounds), _ddl(_schema(width, [("range", pa.int32())])))
    sorted_windows = windows.repartitionById(len(bounds) + 1, "range").drop("range") \
        .sortWithinPartitions("kind", *_names(width))
    out = _schema(width, [("shorter", pa.list_(pa.int64())), ("longer", pa.int64()), ("open", pa.bool_())])
    walked = cut_lineage(sorted_windows.mapInArrow(_walker(width, min_count, False, []), _ddl(out)))
    totals = walked.filter(F.col("w1").isNull()).groupBy("kind").agg(F.sum("n").alias("n_words"))
    spelled = walked.filter(F.col("w1").isNotNull())
    forward = cut_lineage(_joined_runs(spelled, width, min_count, []).withColumn("words", _phrase(width)))

    # The same phrases by their last word, the one before it, and so on.
    turned = forward.select(
        "kind", *[F.get(F.reverse("words"), k).alias(w) for k, w in enumerate(_names(width))],
        "n", F.col("shorter").alias("starts"), F.col("longer").alias("longer_right"))
    carried = [("starts", pa.list_(pa.int64())), ("longer_right", pa.int64())]
    parts = partitions_for(records.sparkSession, forward.count(), RANGE_PHRASES)
    by_end = turned.repartitionByRange(parts, "kind", *_names(width)).sortWithinPartitions(
        "kind", *_names(width))
    back = cut_lineage(by_end.mapInArrow(
        _walker(width, min_count, True, carried), _ddl(pa.schema([*out, *map(pa.field, *zip(*carried))]))))
    phrases = _joined_runs(back, width, min_count, [c for c, _ in carried]).select(
        "kind", F.reverse(_phrase(width)).alias("words"), "n", "starts",
        F.col("shorter").alias("ends"), F.greatest("longer", "longer_right").alias("longer"))
    return phrases, totals


def collocations(
    records: DataFrame, kind: str = "stamp_type", notes: str = "notes", min_count: int = 10,
    max_words: int = 3, inside_percent: int = 50, first: int = 2000, unknown: str = "",
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """The phrases that mark the review notes of each kind of record.

    ``records`` are rows of the review ledger: ``notes`` is free text, ``kind`` the column
    whose values are mined apart (``stamp_type``, ``reviewed_by``, ...). Notes are lower-cased
    (A-Z) and cut at ``. , ; : ! ?`` and line ends into pieces, these at blanks and tabs into
    words. A phrase of 2 to ``max_words`` words that occurs at least ``min_count`` times in a
    kind is cut in two wherever its score 1,000,000 a a / (l r), rounded down, is least (the
    first such place): a counts the phrase, l and r its parts, all occurrences within pieces. A
    phrase goes if a longer frequent one that holds it has at least ``inside_percent`` of its
    count. Of each kind the ``first`` stay, by falling score and count, then by phrase.

    Returns kind, rank (from 1), phrase (joined with blanks), a, l, r, n (words of the kind),
    score. Products are decimals of 38 digits, so they are exact up to 10^15 occurrences. A
    null note is empty and a null kind is ``unknown``; repeated records count each time; other
    columns take no part, whatever they are called; an empty table gives no rows. A very long
    note is one task's work, in pieces; a hot kind, word or phrase is spread over ranges.
    """
    phrases, totals = phrase_counts(
        records, kind, notes, min_count, max_words, unknown, range_bytes)
    wide = lambda c: c.cast("decimal(16,0)")
    million = F.lit(1000000).cast("decimal(7,0)")
    numerator = million * (wide(F.col("n")) * wide(F.col("n")))

    def cut(k: Column) -> Column:
        left, right = F.get("starts", k - 1), F.get("ends", F.size("words") - k - 1)
        parts = wide(left) * wide(right)
        score = (numerator - numerator % parts) / parts  # exact: no digits after the point
        return F.struct(score.cast("long").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    stays = (F.size("words") > 1) & (100 * wide(F.col("longer")) < inside_percent * wide(F.col("n")))
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))
    scored = phrases.filter(stays).select(
        "kind", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), best.alias("c"))
    order = [F.col("c.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # A plain row number: Spark then keeps the first of each kind per task before it shuffles.
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*order)))
    return ranked.filter(F.col("rank") <= first).join(totals, "kind").select(
        "kind", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"),
        F.col("n_words").alias("n"), F.col("c.score").alias("score"))
