"""Quality rules on notes: base counts, and repetition found with suffix arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of one suffix array; a longer note has one of its own.
ARRAY_WORDS = 100_000
BLANKS = "\t\n\x0b\x0c\r"
_SYMBOLS = re.compile(r"[#*$%&|<>]+")
SCORES = ("position long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, repeat_chars long, longest_repeat long")


def split_words(note: str) -> list[str]:
    for blank in BLANKS:
        if blank in note:
            note = note.replace(blank, " ")
    return [w for w in note.split(" ") if w]


def repeated_spans(words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For every word, how long the longest repeat is that begins there (0: below ``least``).

    ``words`` are ids, notes one after the other; ``doc`` says whose word it is; a repeat lies
    in one note. The suffixes that begin with a repeated run of ``least`` words are sorted by
    doubling the compared length; neighbours' common prefixes are then put together from the
    ranks of each length. A suffix's longest repeat is the longer of its two common prefixes.
    """
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    ends = np.r_[np.flatnonzero(np.diff(doc)) + 1, n]
    room = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)

    def paired(rank: np.ndarray, step: int, at: np.ndarray) -> np.ndarray:
        """Rank of twice the length at ``at``: what follows there, 0 past the note's end."""
        follow = np.zeros(len(at), np.int64)
        inside = room[at] > step
        follow[inside] = rank[at[inside] + step] + 1
        return rank[at] * (rank.max() + 2) + follow

    # Runs of exactly `least` words: lengths are added up from powers of two.
    rank, length = words.astype(np.int64), 1
    everywhere = np.arange(n)
    while length < least:
        step = min(length, least - length)
        rank = np.unique(paired(rank, step, everywhere), return_inverse=True)[1]
        length += step
    rank = np.unique(doc.astype(np.int64) * (rank.max() + 1) + rank, return_inverse=True)[1]
    again = np.bincount(rank)[rank] > 1
    at = np.flatnonzero(again & (room >= least))
    if not len(at):
        return longest
    levels = [(least, rank)]
    while True:
        own = np.bincount(rank[at])
        if not (own > 1).any():
            break
        # Longer by doubling, for the suffixes still at stake; the others keep their place in the
        # order of content, which the suffixes that lead to them are sorted by.
        step = levels[-1][0]
        wider = rank * (rank.max() + 2)
        wider[at] = paired(rank, step, at)
        rank = np.unique(wider, return_inverse=True)[1]
        levels.append((2 * step, rank))
    order = at[np.argsort(rank[at])]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for size, ranks in reversed(levels):
        left, right = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        same = (ranks[left] == ranks[right]) & (room[a] - common >= size) & (room[b] - common >= size)
        common += np.where(same, size, 0)
    # The last stretch is shorter than `least`: word by word.
    live = np.flatnonzero(common >= least)
    for _ in range(least - 1):
        x, y = a[live] + common[live], b[live] + common[live]
        fits = (room[a[live]] > common[live]) & (room[b[live]] > common[live])
        x, y, live = x[fits], y[fits], live[fits]
        live = live[words[x] == words[y]]
        common[live] += 1
    common[doc[a] != doc[b]] = 0
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    longest[longest < least] = 0
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + lengths, -1)
    return np.cumsum(mark[:-1]) > 0


def _scores(least: int):
    names = [c.split()[0] for c in SCORES.split(", ")]

    def measure(notes: list[tuple[str, list[str]]]) -> list[tuple]:
        counts = np.array([len(w) for _, w in notes])
        flat = [w for _, ws in notes for w in ws]
        doc = np.repeat(np.arange(len(notes)), counts)
        chars = np.fromiter(map(len, flat), np.int64, len(flat))
        ids = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, np.int64)
        longest = repeated_spans(ids, doc, least)
        at = np.flatnonzero(longest)
        window = _covered(at, np.full(len(at), least), len(flat))
        span = _covered(at, longest[at], len(flat))
        total = lambda x: np.bincount(doc, weights=x, minlength=len(notes)).astype(np.int64)
        peak = np.zeros(len(notes), np.int64)
        np.maximum.at(peak, doc, longest)
        rows = zip(counts.tolist(), total(chars).tolist(), total(window).tolist(),
                   total(chars * span).tolist(), peak.tolist())
        out = []
        for (note, _), (n_words, word_chars, repeat_words, repeat_chars, most) in zip(notes, rows):
            symbols = sum(map(len, _SYMBOLS.findall(note)))
            lines = [x for x in note.split("\n") if x.strip(" " + BLANKS)]
            out.append((n_words, word_chars, symbols, len(lines) - len(set(lines)),
                        repeat_words, repeat_chars, most))
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, size = [], [], 0
            for note in batch[1].to_pylist():
                words = split_words(note or "")
                if held and size + len(words) > ARRAY_WORDS:
                    rows += measure(held)
                    held, size = [], 0
                held.append((note or "", words))
                size += len(words)
            if held:
                rows += measure(held)
            columns = list(zip(*rows)) or [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch[0].cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return score


def judge_notes(
    records: DataFrame, position: str = "position", notes: str = "notes", least: int = 8,
    max_covered: float = 0.30, max_longest: int = 256, keep: list[str] | None = None,
) -> DataFrame:
    """Quality of the notes of review records.

    A note fails the base rules with under 20 words, or when more than 30 % of its words lie
    in windows of ``least`` words that occur again in it. The suffix array's verdict rejects a
    note when the union of its maximal repeated runs (``least`` words or longer) covers more
    than ``max_covered`` of its word characters, or one run has over ``max_longest`` words.

    Words are runs of anything but ASCII white space. Returns position, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, repeat_chars, longest_repeat (all long),
    base_failed and kept; ``keep`` names columns to carry along. A null note has no words and
    fails. Positions may be null or repeat, rows may repeat: each row is judged by itself.
    """
    keep = keep or []
    rows = records.select(
        F.col(position).cast("long").alias("position"), F.col(notes).cast("string").alias("notes"),
        *([F.struct(*keep).alias("_kept")] if keep else []),
    )
    if keep:
        scored = rows.mapInArrow(_with_rest(_scores(least)), _schema_with(rows, SCORES))
    else:
        scored = rows.mapInArrow(_scores(least), SCORES)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = (F.col("repeat_chars") <= max_covered * F.col("word_chars")) & (
        F.col("longest_repeat") <= max_longest
    )
    out = scored.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & fine)
    return out.select(*[c for c in out.columns if c != "_kept"], *[F.col(f"_kept.`{c}`") for c in keep])


def _schema_with(rows: DataFrame, scores: str):
    return T.StructType([*T.StructType.fromDDL(scores).fields, rows.schema["_kept"]])


def _with_rest(score):
    """Scores of each batch, with its third column behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in score(iter([batch])):
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, batch[2]], names=[*out.schema.names, "_kept"])

    return run
