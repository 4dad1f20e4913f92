"""Toxic review notes: a convolutional classifier over hashed word embeddings, in numpy.

A word's vector is the sum of three embeddings, found by hashes of the word and of its first
four and five letters. Filters of several widths slide over a note, each keeps its largest
value, and a logistic layer weighs them.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkledger.session import cut_lineage

BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
WEIGHTS = ("embeddings", "filters", "bias", "weights")
RATE = 0.08
BATCH = 48
# Passes over all labelled notes; few notes are gone through more often, for at least so many steps.
PASSES = 2
LEAST_STEPS = 450
# Notes of a part that learns by itself between two averages, and how many parts there are at most.
PART_NOTES = 10_800
MOST_PARTS = 32
# Steps between 0 and 1 on which scores are counted for a threshold; a power of two cuts exactly.
GRID = 1 << 14
DEFAULT_THRESHOLD = 0.7
MIN_CALIBRATION = 10
SPAN_WORDS = 100_000
CACHED_WORDS = 100_000
_EDGE = ".,;:!?\"'()[]{}«»¿¡*#$%&|<>-"


def word_hashes(word: str) -> tuple[int, int, int]:
    """Buckets of a word and of its beginnings; case and punctuation around it don't count."""
    word = word.strip(_EDGE).lower()
    if not word:
        return 0, 0, 0
    return tuple(1 + zlib.crc32(x.encode()) % (BUCKETS - 1) for x in
                 ("w" + word, "p" + word[:4], "q" + word[:5]))


class _Hashes(dict):
    def __missing__(self, word: str) -> tuple[int, int, int]:
        got = word_hashes(word)
        if len(self) < CACHED_WORDS:
            self[word] = got
        return got


_HASHES = _Hashes()


@dataclass
class ToxicityModel:
    """Weights and the thresholds by language (``None``: any other)."""

    embeddings: np.ndarray
    filters: np.ndarray  # DIM x columns; a filter of width w owns w columns, word by word
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @staticmethod
    def columns() -> list[tuple[int, int]]:
        """(width, first column) of each width's block; word k of it is at + k * FILTERS."""
        ends = np.cumsum([0, *[w * FILTERS for w in WIDTHS]])
        return list(zip(WIDTHS, ends.tolist()))

    @classmethod
    def fresh(cls, seed: int) -> ToxicityModel:
        draw = np.random.default_rng(seed)
        wide = FILTERS * sum(WIDTHS)
        embeddings = draw.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        embeddings[0] = 0  # no word
        return cls(embeddings, draw.normal(0, 0.3, (DIM, wide)).astype(np.float32),
                   np.zeros(FILTERS * len(WIDTHS), np.float32),
                   draw.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)

    def responses(self, hashes: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """Filter values at every word; ``hashes`` of the distinct words, ``inverse`` the text."""
        table = (self.embeddings[hashes].sum(1) @ self.filters).astype(np.float32)
        at = table[inverse]
        out = np.empty((len(inverse), FILTERS * len(WIDTHS)), np.float32)
        for k, (width, first) in enumerate(self.columns()):
            block = out[:, k * FILTERS:(k + 1) * FILTERS]
            block[:] = at[:, first:first + FILTERS]
            for o in range(1, width):
                block[:-o] += at[o:, first + o * FILTERS:first + (o + 1) * FILTERS]
        return out

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        x = np.maximum(pooled + self.bias, 0) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))


def _encode(notes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words, the text in them (blanks after each note) and note starts."""
    flat: list[str] = []
    starts = []
    for note in notes:
        starts.append(len(flat))
        flat += note.split()
        flat += [""] * max(WIDTHS)
    inverse, words = pd.factorize(np.array(flat, dtype=object))
    hashes = np.array([_HASHES[w] for w in words], np.int64).reshape(-1, 3)
    return hashes, inverse, np.array(starts)


@dataclass
class _Learner:
    """A network and the Adagrad sums of its weights."""

    model: ToxicityModel
    grown: dict[str, np.ndarray]
    grown_intercept: float = 1e-3

    @classmethod
    def fresh(cls, seed: int) -> _Learner:
        model = ToxicityModel.fresh(seed)
        return cls(model, {k: np.full_like(getattr(model, k), 1e-3) for k in WEIGHTS})

    def _move(self, name: str, at, gradient: np.ndarray) -> None:
        seen, value = self.grown[name], getattr(self.model, name)
        seen[at] += gradient * gradient
        value[at] -= RATE * gradient / np.sqrt(seen[at])

    def step(self, notes: list[str], toxic: np.ndarray) -> None:
        """One step down the log loss of some whole notes."""
        model = self.model
        hashes, inverse, starts = _encode(notes)
        out = model.responses(hashes, inverse)
        ends = np.r_[starts[1:], len(inverse)]
        best = np.array([out[a:b].argmax(0) + a for a, b in zip(starts, ends)])
        pooled = np.take_along_axis(out, best, 0)
        live = pooled + model.bias
        off = (model.probability(pooled) - toxic).astype(np.float32) / len(notes)
        hidden = np.maximum(live, 0)
        back = off[:, None] * model.weights * (live > 0)
        self._move("weights", slice(None), hidden.T @ off)
        self.grown_intercept += float(off.sum()) ** 2
        model.intercept -= RATE * float(off.sum()) / self.grown_intercept ** 0.5
        to_filters = np.zeros_like(model.filters)
        rows, steps = [], []
        for k, (width, first) in enumerate(model.columns()):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            for o in range(width):
                words = hashes[inverse[np.minimum(best[:, part] + o, len(inverse) - 1)]]
                column = slice(first + o * FILTERS, first + (o + 1) * FILTERS)
                vectors = model.embeddings[words].sum(2)  # notes x FILTERS x DIM
                g = back[:, part]
                to_filters[:, column] += np.einsum("nf,nfd->df", g, vectors)
                step = g[:, :, None] * model.filters[:, column].T[None]
                for part_of_word in range(3):
                    rows.append(words[:, :, part_of_word].ravel())
                    steps.append(step.reshape(-1, DIM))
        at, place = np.unique(np.concatenate(rows), return_inverse=True)
        to_words = np.zeros((len(at), DIM), np.float32)
        np.add.at(to_words, place, np.concatenate(steps))
        to_words[at == 0] = 0
        self._move("embeddings", at, to_words)
        self._move("filters", slice(None), to_filters)
        self._move("bias", slice(None), back.sum(0).reshape(FILTERS * len(WIDTHS)))


def _average(before: _Learner, parts: list[tuple[int, _Learner]]) -> _Learner:
    """The learners of several parts as one, by their notes; a word counts where it was met."""
    total = sum(n for n, _ in parts)
    out = _Learner.fresh(0)
    for held, of in ((out.model.__dict__, lambda x: x.model.__dict__), (out.grown, lambda x: x.grown)):
        for name in WEIGHTS:
            if name != "embeddings":
                held[name] = sum(n / total * of(x)[name] for n, x in parts).astype(np.float32)
                continue
            sums, counts = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
            for n, x in parts:
                met = (x.grown[name] != before.grown[name]).any(1)
                sums[met] += n * of(x)[name][met]
                counts[met] += n
            held[name] = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None],
                                  of(before)[name]).astype(np.float32)
    out.model.intercept = sum(n / total * x.model.intercept for n, x in parts)
    out.grown_intercept = sum(n / total * x.grown_intercept for n, x in parts)
    return out


def _learn_parts(batches: Iterator[pa.RecordBatch], held, turns: int) -> Iterator[pa.RecordBatch]:
    """Go over the notes of each part from the common learner; (part, notes, learner).

    One turn takes the notes as they come; more are for a part that is small enough to be held.
    """
    part, before, learner, seen, notes, toxic = None, None, None, 0, [], []

    def out() -> pa.RecordBatch:
        labels, order = np.array(toxic, np.float32), np.arange(len(notes))
        draw = np.random.default_rng(part)
        for _ in range(turns):
            if turns > 1:
                draw.shuffle(order)
            for at in range(0, len(order), BATCH):
                picks = order[at:at + BATCH]
                learner.step([notes[i] for i in picks], labels[picks])
        return pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "seen": pa.array([seen], pa.int64()),
             "learner": pa.array([pickle.dumps(learner)], pa.binary())})

    for batch in batches:
        for number, position, note, label in zip(*(c.to_pylist() for c in batch.columns)):
            if number != part:
                if learner is not None:
                    yield out()
                part, before, learner, seen, notes, toxic = number, None, pickle.loads(held.value), 0, [], []
            if position == before:  # a position's first note counts
                continue
            before, seen = position, seen + 1
            notes.append(note)
            toxic.append(label)
            if turns == 1 and len(notes) == BATCH:
                learner.step(notes, np.array(toxic, np.float32))
                notes.clear()
                toxic.clear()
    if learner is not None:
        yield out()


def _parts(notes: int) -> int:
    """Parts of about PART_NOTES notes, MOST_PARTS of them at most."""
    return min(MOST_PARTS, max(1, notes // PART_NOTES))


def _train(rows: DataFrame, notes: int, seed: int) -> ToxicityModel:
    """Fit the network by Adagrad on all notes, in parts that are averaged after each pass.

    ``rows`` (part, position, notes, toxic) is a written table with a part's notes in order. Every part
    begins a pass with the common learner; what is averaged has a fixed size. Notes that make
    one part are held by a task, which goes over them until the network has made enough steps.
    """
    spark = rows.sparkSession
    few = notes < PART_NOTES
    turns = max(PASSES, -(-LEAST_STEPS * BATCH // max(1, notes))) if few else 1
    learner = _Learner.fresh(seed)
    for _ in range(1 if few else PASSES):
        held = spark.sparkContext.broadcast(pickle.dumps(learner))
        made = rows.select("part", "position", "notes", "toxic").mapInArrow(
            lambda batches: _learn_parts(batches, held, turns), "part int, seen long, learner binary").collect()
        if made:
            made = [(r["seen"], pickle.loads(r["learner"])) for r in sorted(made, key=lambda r: (r["part"], r["seen"]))]
            learner = _average(learner, made)
        held.unpersist()
    return learner.model


def score_texts(model: ToxicityModel, notes: list[str]) -> np.ndarray:
    """Probabilities of whole notes, in spans of bounded size."""
    scores, held, size = [], [], 0

    def flush():
        hashes, inverse, starts = _encode(held)
        pooled = np.maximum.reduceat(model.responses(hashes, inverse), starts, axis=0)
        scores.append(model.probability(pooled))

    for note in notes:
        words = note.count(" ") + 1
        if held and size + words > SPAN_WORDS:
            flush()
            held, size = [], 0
        held.append(note)
        size += words
    if held:
        flush()
    return np.concatenate(scores) if scores else np.zeros(0)


def _best_cuts(scored: DataFrame, by: list[str]) -> DataFrame:
    """The cut with the best F1 per group of ``by``, of groups with enough notes of either label.

    Scores are counted on a grid of GRID steps, so a group has at most that many rows; the cut
    is the middle of the gap between the occupied steps. Equal F1 go to the cut nearest 0.5.
    """
    counts = scored.groupBy(*by, F.floor(F.col("score") * GRID).alias("bin")).agg(
        F.count_if(F.col("toxic") == 1).alias("hits"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    above = group.orderBy(F.col("bin").desc())
    runs = counts.withColumns({
        "all_hits": F.sum("hits").over(group), "all": F.sum("n").over(group),
        "got": F.sum("hits").over(above), "taken": F.sum("n").over(above),
        "below": F.lead("bin").over(above)})
    cut = (F.col("bin") + F.coalesce(F.col("below") + 1, F.lit(0))) / (2.0 * GRID)
    best = F.struct((2 * F.col("got") / (F.col("taken") + F.col("all_hits"))).alias("f1"), (-F.abs(cut - 0.5)).alias("near"), cut.alias("cut"))
    least = MIN_CALIBRATION if by != ["one"] else 1
    return runs.filter((F.col("all_hits") >= least) & (F.col("all") - F.col("all_hits") >= least)).groupBy(*by).agg(
        F.max(best)["cut"].alias("cut"))


def fit_toxicity(
    records: DataFrame, labels: DataFrame, position: str = "position", notes: str = "notes",
    toxic: str = "toxic", language: str | None = None, seed: int = 7,
) -> ToxicityModel:
    """Learn toxicity from all labelled review notes.

    ``labels`` holds position and ``toxic`` (0 or 1, others are left out; of several 1 counts). Four in five
    notes train the network, one in five calibrates a threshold per ``language`` (best F1; a language
    with under MIN_CALIBRATION notes of either label shares the common one). Every labelled
    note takes part; of several notes at a position the first in order does. Without both
    labels the model stays untrained and scores by its prior. Null notes are empty.
    """
    known = labels.select(F.col(position).alias("position"), F.col(toxic).alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & F.col("position").isNotNull()
    ).groupBy("position").agg(F.max("toxic").cast("float").alias("toxic"))
    lang = F.col(language).cast("string") if language else F.lit(None).cast("string")
    rows = records.select(
        F.col(position).alias("position"), F.coalesce(F.col(notes).cast("string"), F.lit("")).alias("notes"),
        lang.alias("language"),
    )
    fold = F.floor(F.crc32(F.col("position").cast("string").cast("binary")) / 3) % 5
    # Labels grow with the notes, so neither side is broadcast. A part is written once, in order.
    parts = _parts(known.count())
    order = F.xxhash64("position", F.lit(seed))
    got = cut_lineage(rows.hint("merge").join(known, "position").select(
        "*", (fold == 0).alias("aside"), F.pmod(order, F.lit(parts)).cast("int").alias("part"),
    ).repartition(parts, "part").sortWithinPartitions("part", order, "position", "notes"))
    held = {r["toxic"]: r["n"] for r in got.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(held) < 2:
        model = ToxicityModel.fresh(seed)
        model.weights[:] = 0
        model.intercept = 4.0 if 1.0 in held else -4.0
        model.thresholds = {None: DEFAULT_THRESHOLD}
        return model
    model = _train(got.filter("not aside"), got.filter("not aside").count(), seed)
    model.thresholds = {None: DEFAULT_THRESHOLD}
    shared = records.sparkSession.sparkContext.broadcast(model)
    # A position's first note counts.
    aside = got.filter("aside").select(
        "notes", F.struct("position", "language", "toxic", F.col("notes").alias("note")).alias("_row"))
    schema = T.StructType([T.StructField("score", T.DoubleType()), aside.schema["_row"]])
    scored = cut_lineage(aside.mapInArrow(lambda batches: _score_batches(batches, shared), schema).groupBy(
        F.col("_row.position").alias("position")).agg(
        F.min(F.struct(F.col("_row.note").alias("note"), F.col("_row.language").alias("language"),
                       F.col("_row.toxic").alias("toxic"), "score")).alias("r")).select("r.language", "r.toxic", "r.score"))
    for r in _best_cuts(scored.withColumn("one", F.lit(1)), ["one"]).collect():
        model.thresholds[None] = r["cut"]
    for r in _best_cuts(scored.filter("language is not null"), ["language"]).collect():
        model.thresholds[r["language"]] = r["cut"]
    return model


def _score_batches(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    model = held.value
    for batch in batches:
        scores = score_texts(model, [n or "" for n in batch[0].to_pylist()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(scores, pa.float64()), *batch.columns[1:]],
            names=["score", *batch.schema.names[1:]])


def score_notes(
    records: DataFrame, model: ToxicityModel, notes: str = "notes", language: str | None = None,
) -> DataFrame:
    """All columns of ``records`` in ``_row`` with score, threshold and rejected beside it.

    Every note is scored whole; null and empty notes score as a note without words. Language
    only picks the threshold, never the score. One row per record, repeats included.
    """
    spark = records.sparkSession
    held = spark.sparkContext.broadcast(model)  # of fixed size
    rows = records.select(
        F.col(notes).cast("string").alias("_notes"), F.struct(*records.columns).alias("_row"))
    schema = T.StructType([T.StructField("score", T.DoubleType()), rows.schema["_row"]])
    scored = rows.mapInArrow(lambda batches: _score_batches(batches, held), schema)
    common = F.lit(model.thresholds.get(None, DEFAULT_THRESHOLD))
    threshold: Column = common
    if language:
        for one, value in model.thresholds.items():
            if one is not None:
                threshold = F.when(F.col(f"_row.`{language}`") == one, F.lit(value)).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn(
        "rejected", F.col("score") >= F.col("threshold"))
