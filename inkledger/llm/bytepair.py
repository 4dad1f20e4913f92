"""Byte-level BPE of whole notes: ranked merges folded by higher-order functions.

The distinct pieces of all notes are counted; the frequent ones are folded once, into a
table in the shared folder that every Python worker reads. Notes are then put together from
that table, and a piece that it does not hold is folded where it stands, by the same fold.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm.store import open_folder
from inkledger.llm.tokens import _BLANK_RUN, _SAFE_CUT
from inkledger.session import scratch_path

# The word table's size: at most this many pieces of at most PIECE_BYTES bytes.
FREQUENT = 500_000
PIECE_BYTES = 64
CACHED_WORDS = 300_000
# The fold takes time with the square of a piece; longer ones are merged with a heap.
FOLD_BYTES = 256
MAP_BUCKETS = 1 << 16
NO_RANK = 1 << 22


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes -> rank of a rank file: lines of base64 text and number."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(ranks.values()) > 0xFFFF or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must cover all bytes and stay below 65,536")
    return ranks


@functools.cache
def pair_ranks(path: str) -> dict[int, int]:
    """left id * 65,536 + right id -> rank of the two joined, for every way to split a token."""
    ranks = read_ranks(path)
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 16 | right] = rank
    return pairs


@functools.cache
def _byte_ids(path: str) -> list[int]:
    ranks = read_ranks(path)
    return [ranks[bytes([b])] for b in range(256)]


@functools.cache
def _rank_json(path: str) -> str:
    buckets: list[dict[int, int]] = [{} for _ in range(MAP_BUCKETS)]
    for key, rank in pair_ranks(path).items():
        buckets[(key >> 16) * 31 + (key & 0xFFFF) & MAP_BUCKETS - 1][key] = rank << 40
    return json.dumps(buckets, separators=(",", ":"))


@functools.cache
def _byte_pair_json(path: str) -> str:
    pairs, ids = pair_ranks(path), _byte_ids(path)
    least, span = min(ids), max(ids) - min(ids) + 1
    ranks = [NO_RANK << 40] * (span * span)
    for left in ids:
        for right in ids:
            ranks[(left - least) * span + right - least] = pairs.get(left << 16 | right, NO_RANK) << 40
    return json.dumps(ranks, separators=(",", ":"))


def rank_map(path: str) -> Column:
    """The literal rank map: pairs of ids in small maps, found by a hash of the pair; ranks are shifted by 40 bits."""
    return F.from_json(F.lit(_rank_json(path)), "array<map<string,bigint>>").cast(
        "array<map<bigint,bigint>>"
    )


def fold_merges(codes: Column, path: str) -> Column:
    """Ids of one piece from the ids of its bytes.

    The fold's state holds a long per part: the rank of the part joined with the next one,
    the part's place, and its id. The least long is therefore the leftmost pair of lowest
    rank; one step joins it and looks up the two ranks that change. The ranks of two bytes, which
    begin the fold, stand in a literal array of their own.
    """
    ids = _byte_ids(path)
    least, span = min(ids), max(ids) - min(ids) + 1
    if span > 1024:
        byte_pairs = None
    else:
        byte_pairs = F.from_json(F.lit(_byte_pair_json(path)), "array<bigint>")

    def begin(x: Column, i: Column, wide: Column, table: Column, pairs: Column | None) -> Column:
        after = F.get(wide, i + 1)
        if pairs is None:
            rank = _ranked(table, x, after)
        else:
            rank = F.get(pairs, (x * span + after - least * (span + 1)).cast("int"))
        return F.coalesce(rank, F.lit(NO_RANK << 40)).bitwiseOR(F.shiftleft(i.cast("long"), 16)).bitwiseOR(x)

    def folded(table: Column, pairs: Column | None) -> Column:
        wide = codes.cast("array<bigint>")
        start = F.get(F.transform(
            F.array(wide), lambda held: F.transform(held, lambda x, i: begin(x, i, held, table, pairs))), 0)
        merged = F.aggregate(F.slice(codes, F.lit(2), F.size(codes)), start, lambda parts, _: _step(parts, table))
        return F.when(F.size(codes) < 2, codes).otherwise(
            F.transform(merged, lambda part: _id_of(part).cast("int")))

    # Bound to variables, so that the plan holds each literal once.
    def with_pairs(table: Column) -> Column:
        if byte_pairs is None:
            return folded(table, None)
        return F.get(F.transform(F.array(byte_pairs), lambda pairs: folded(table, pairs)), 0)

    return F.get(F.transform(F.array(rank_map(path)), with_pairs), 0)


def _ranked(table: Column, left: Column, right: Column) -> Column:
    """Rank of two ids joined, shifted by 40 bits; null if they don't join or there is no second one."""
    bucket = F.get(table, (left * 31 + right).bitwiseAND(F.lit(MAP_BUCKETS - 1)).cast("int"))
    return F.try_element_at(bucket, F.shiftleft(left, 16).bitwiseOR(right))


def _id_of(part: Column) -> Column:
    return part.bitwiseAND(F.lit(0xFFFF))


def _step(parts: Column, table: Column) -> Column:
    """Joins the part of least rank with the next one; without such a part all stays."""

    def join(at: Column) -> Column:
        least, before = F.get(parts, at), F.get(parts, at - 1)
        merged, none = F.shiftright(least, 40), F.lit(NO_RANK << 40)
        here = F.coalesce(_ranked(table, merged, _id_of(F.get(parts, at + 2))), none).bitwiseOR(
            least.bitwiseAND(F.lit(0xFFFFFF0000))).bitwiseOR(merged)
        # The parts behind move up by one place.
        rest = F.transform(F.slice(parts, at + 3, F.size(parts)), lambda part: part - F.lit(1 << 16))
        led = F.coalesce(_ranked(table, _id_of(before), merged), none).bitwiseOR(
            before.bitwiseAND(F.lit((1 << 40) - 1)))
        return F.when(least >= none, parts).when(at < 1, F.flatten(F.array(F.array(here), rest))).otherwise(
            F.flatten(F.array(F.slice(parts, F.lit(1), at - 1), F.array(led, here), rest)))

    # Read from the least part: array_position held 110 of 190 stack samples of a draft.
    place = F.shiftright(F.array_min(parts), 16).bitwiseAND(F.lit(0xFFFFFF)).cast("int")
    return F.get(F.transform(F.array(place), join), 0)


def merge_long(codes: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges for a very long piece, in n log n."""
    ids: list[int | None] = list(codes)
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:]))
            if (r := pairs.get(a << 16 | b)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j] = rank, None
        after[i] = after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < len(ids):
                pair = ids[left], ids[after[left]]
                if (r := pairs.get(pair[0] << 16 | pair[1])) is not None:
                    heapq.heappush(heap, (r, left, *pair))
    return [x for x in ids if x is not None]


class _Pieces:
    """Cuts notes to words, words to pieces and pieces to byte ids."""

    def __init__(self, path: str, pattern: str):
        self.path, self.find, self.byte_ids = path, regex.compile(pattern).findall, _byte_ids(path)

    @staticmethod
    def words(note: str) -> list[str]:
        return _SAFE_CUT.split(note) if _BLANK_RUN.search(note) else note.split(" ")

    def codes(self, piece: str) -> list[list[int]]:
        """What the fold gets for a piece: its bytes' ids, or the final ids one by one."""
        ids = [self.byte_ids[b] for b in piece.encode()]
        if len(ids) <= FOLD_BYTES:
            return [ids]
        return [[x] for x in merge_long(ids, pair_ranks(self.path))]


def _count_pieces(path: str, pattern: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = _Pieces(path, pattern), Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                names=["piece", "n"])

        for batch in batches:
            words: Counter[str] = Counter()
            for note in batch[0].to_pylist():
                first, *rest = cut.words(note or "")
                counts.update(cut.find(first))
                words.update(rest)
            for word, n in words.items():
                if word.isalpha():
                    counts[" " + word] += n
                else:
                    for piece in cut.find(" " + word):
                        counts[piece] += n
            if len(counts) > 1_000_000:
                yield out()
                counts.clear()
        yield out()

    return count


def _code_pieces(path: str, pattern: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _Pieces(path, pattern)
        for batch in batches:
            codes = [cut.codes(p)[0] for p in batch[0].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(codes, pa.list_(pa.int32()))], names=["piece", "codes"])

    return code


class _Words(dict):
    """Word -> its packed ids, or None when the table lacks one of its pieces."""

    def __init__(self, lead: str, table: dict[str, bytes], find):
        super().__init__()
        self.lead, self.table, self.find = lead, table, find

    def __missing__(self, word: str) -> bytes | None:
        text = self.lead + word
        packed = self.table.get(text)
        if packed is None:
            got = [self.table.get(p) for p in self.find(text)]
            packed = None if None in got else b"".join(got)
        if len(self) < CACHED_WORDS and len(word) <= PIECE_BYTES:
            self[word] = packed
        return packed


_TABLES: dict[str, tuple[_Words, _Words]] = {}


def _word_tables(folder: str, find) -> tuple[_Words, _Words]:
    """The frequent pieces, read once by each worker; a new table replaces the old."""
    if folder not in _TABLES:
        _TABLES.clear()
        system, path = open_folder(folder)
        table: dict[str, bytes] = {}
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.path.endswith(".parquet"):
                for batch in pq.ParquetFile(system.open_input_file(info.path)).iter_batches():
                    offsets = batch["ids"].offsets.to_numpy() * 2
                    raw = batch["ids"].values.to_numpy().astype("<u2").tobytes()
                    table.update(zip(batch["piece"].to_pylist(),
                                     (raw[a:b] for a, b in zip(offsets, offsets[1:]))))
        _TABLES[folder] = _Words("", table, find), _Words(" ", table, find)
    return _TABLES[folder]


def _assemble(folder: str, path: str, pattern: str):
    """Notes as known runs of ids, and between them the byte ids of pieces still to fold."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _Pieces(path, pattern)
        first_words, words = _word_tables(folder, cut.find)
        table = words.table
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                runs: list[bytes] = []
                codes: list[list[int]] = []
                run_ends, code_ends = [0], [0]
                for note in batch[1].to_pylist():
                    parts = cut.words(note or "")
                    packed = list(map(words.__getitem__, parts))
                    packed[0] = first_words[parts[0]]
                    done = 0
                    held: list[bytes] = []
                    if None in packed:
                        for i in [i for i, p in enumerate(packed) if p is None]:
                            held += packed[done:i]
                            for piece in cut.find((" " if i else "") + parts[i]):
                                known = table.get(piece)
                                if known is not None:
                                    held.append(known)
                                    continue
                                for code in cut.codes(piece):
                                    runs.append(b"".join(held))
                                    codes.append(code)
                                    held = []
                            done = i + 1
                    runs.append(b"".join([*held, *packed[done:]]))
                    run_ends.append(len(runs))
                    code_ends.append(len(codes))
                ids = np.frombuffer(b"".join(runs), "<u2").astype(np.int32)
                offsets = np.r_[0, np.cumsum([len(r) // 2 for r in runs])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch[0],
                     pa.ListArray.from_arrays(np.array(run_ends, np.int32),
                                              pa.ListArray.from_arrays(offsets, pa.array(ids))),
                     pa.ListArray.from_arrays(np.array(code_ends, np.int32),
                                              pa.array(codes, pa.list_(pa.int32())))],
                    names=["position", "runs", "open_pieces"])

    return assemble


def encode_notes(
    records: DataFrame, ranks: str, pattern: str, position: str = "position",
    notes: str = "notes", frequent: int = FREQUENT,
) -> DataFrame:
    """Token ids of the whole notes of review records, by the ranks of a rank file.

    Each match of ``pattern`` is encoded separately, without special tokens. Returns position
    and token_ids (array of int), one row per record. A null or empty note gives an empty
    array; positions may be null or repeat; other columns are ignored; an empty table gives no
    rows. ``frequent`` bounds the table of pieces that workers keep; pieces beyond it are
    folded per occurrence, with the same result.
    """
    spark = records.sparkSession
    rows = records.select(
        F.col(position).cast("long").alias("position"), F.col(notes).cast("string").alias("notes")
    )
    counts_at, words_at = scratch_path(spark), scratch_path(spark)
    (rows.select("notes").mapInArrow(_count_pieces(ranks, pattern), "piece string, n long")
     .filter(F.octet_length("piece") <= PIECE_BYTES)
     .groupBy("piece").agg(F.sum("n").alias("n")).write.parquet(counts_at))
    counts = spark.read.schema("piece string, n long").parquet(counts_at)
    # How many pieces occur n times: the least n whose pieces and all commoner ones fit.
    least, held = None, 0
    for n, pieces in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        held += pieces
        if held > frequent:
            break
        least = n
    common = counts.filter(F.col("n") >= (least or 1 << 62)).select("piece")
    tasks = max(1, spark.sparkContext.defaultParallelism)
    (common.repartition(tasks, "piece")
     .mapInArrow(_code_pieces(ranks, pattern), "piece string, codes array<int>")
     .select("piece", fold_merges(F.col("codes"), ranks).alias("ids")).write.parquet(words_at))
    parts = rows.mapInArrow(
        _assemble(words_at, ranks, pattern),
        "position long, runs array<array<int>>, open_pieces array<array<int>>",
    )
    folded = F.transform("open_pieces", lambda codes: fold_merges(codes, ranks))
    joined = F.flatten(
        F.zip_with("runs", folded, lambda run, ids: F.concat(
            run, F.coalesce(ids, F.array().cast("array<int>"))))
    )
    return parts.select(
        "position",
        F.when(F.size("open_pieces") == 0, F.get("runs", F.lit(0))).otherwise(joined)
        .alias("token_ids"),
    )


def _pieces_of(ranks: str) -> pa.LargeBinaryArray:
    pieces = [b""] * (max(read_ranks(ranks).values()) + 1)
    for token, rank in read_ranks(ranks).items():
        pieces[rank] = token
    return pa.array(pieces, pa.large_binary())


def _decode(ranks: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces_of(ranks)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                ids, per_note = batch[1].flatten(), batch[1].value_lengths().fill_null(0).to_numpy()
                taken = pieces.take(ids)
                # The taken pieces lie one after the other; a note begins where its first piece does.
                begins = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1, taken.offset * 8)
                ends = pa.py_buffer(begins[np.r_[0, np.cumsum(per_note)]].tobytes())
                notes = pa.Array.from_buffers(
                    pa.large_binary(), len(batch), [None, ends, taken.buffers()[2]])
                yield pa.RecordBatch.from_arrays(
                    [batch[0], batch[1], notes.cast(pa.binary())], names=["position", "token_ids", "note_bytes"])

    return decode


def decode_notes(
    encoded: DataFrame, ranks: str, position: str = "position", token_ids: str = "token_ids",
) -> DataFrame:
    """position, token_ids and note_bytes: the binary pieces of a note's ids, one after the other.

    An empty or null array gives no bytes; positions may be null or repeat; other columns are
    ignored; an empty table gives no rows; an id that the rank file lacks raises.
    """
    rows = encoded.select(F.col(position).cast("long").alias("position"),
                          F.col(token_ids).cast("array<int>").alias("token_ids"))
    return rows.mapInArrow(_decode(ranks), "position long, token_ids array<int>, note_bytes binary")
