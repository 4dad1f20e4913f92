"""Review notes as token-id record files with a separate offset index.

A record file is a run of frames: length (8 bytes), its masked checksum (4), the payload,
its masked checksum (4), all little-endian. The payload is one note: a null mark, its
position and its ids. The index file beside it holds, per record, the frame's offset, the
ids of the file before it and its own ids, so a shuffled reader can seek to any record.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkledger.llm.store import open_folder, partitions_for
from inkledger.llm.tokens import encoder

HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
NOTE = struct.Struct("<?qB")  # position is null, position, bytes of one id
ENTRY = struct.Struct("<QQQ")  # frame offset, ids of the file before, ids
BUFFER = 8 << 20
BATCH_BYTES = 16 << 20

MANIFEST = "part int, file string, n_records long, n_tokens long"


def masked(data: bytes) -> int:
    """Checksum, rotated and shifted so that a checksum of checksums stays meaningful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + TAIL.pack(masked(size)) + payload + TAIL.pack(masked(payload))


def read_frame(stream) -> bytes | None:
    """The next payload, or None at the end; ValueError on damage."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or masked(head[:8]) != HEAD.unpack(head)[1]:
        raise ValueError("record length is damaged")
    size = HEAD.unpack(head)[0]
    payload, tail = stream.read(size), stream.read(TAIL.size)
    if len(payload) < size or len(tail) < TAIL.size or TAIL.unpack(tail)[0] != masked(payload):
        raise ValueError("record is damaged")
    return payload


def _write(
    batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, pattern: str, end_id: int
) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    coder = encoder(tokenizer, pattern)
    end = np.array([end_id], coder.dtype).tobytes()
    width = coder.dtype.itemsize
    # An attempt writes under a name of its own; only files of the manifest count.
    name = f"notes-{part:06d}-{uuid.uuid4().hex}"
    system, path = open_folder(folder)
    records = tokens = offset = 0
    data = index = None
    try:
        for batch in batches:
            for position, note in zip(batch[0].to_pylist(), batch[1]):
                if data is None:
                    data = system.open_output_stream(f"{path}/{name}.rec", buffer_size=BUFFER)
                    index = system.open_output_stream(f"{path}/{name}.idx", buffer_size=BUFFER)
                ids = coder.packed(note.as_py() or "") + end
                framed = frame(NOTE.pack(position is None, position or 0, width) + ids)
                count = len(ids) // width
                data.write(framed)
                index.write(ENTRY.pack(offset, tokens, count))
                records, tokens, offset = records + 1, tokens + count, offset + len(framed)
    finally:
        if data is not None:
            data.close()
            index.close()
    if records:
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "file": name, "n_records": records, "n_tokens": tokens}],
            schema=pa.schema([("part", pa.int32()), ("file", pa.string()),
                              ("n_records", pa.int64()), ("n_tokens", pa.int64())]),
        )


def write_notes(
    records: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int,
    position: str = "position", notes: str = "notes", partitions: int | None = None,
) -> DataFrame:
    """Write the notes of review records to record files in ascending position order.

    ``folder`` is shared by all executors. Each note is encoded whole by the byte-level
    tokenizer file ``tokenizer`` (``pattern`` is its word pattern) and ends with ``end_id``.
    Returns the manifest, one row per file in order, also kept as ``folder/manifest``: a file
    that it does not name is a lost attempt's. A null note is empty and gives one id; null
    positions come first; rows with equal positions are all written, in the order of their
    notes; an empty table gives an empty manifest. Other columns are ignored.
    """
    spark = records.sparkSession
    if partitions is None:
        partitions = partitions_for(spark, records.count(), 200_000)
    rows = records.select(
        F.col(position).cast("long").alias("position"), F.col(notes).cast("string").alias("notes")
    )
    dealt = rows.repartitionByRange(partitions, "position").sortWithinPartitions("position", "notes")
    dealt.mapInArrow(lambda b: _write(b, folder, tokenizer, pattern, end_id), MANIFEST).write.parquet(
        f"{folder}/manifest"
    )
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("position", pa.int64()), ("in_file", pa.int64()),
                        ("n_tokens", pa.int64()), ("token_bytes", pa.binary())])
    system, path = open_folder(folder)
    for batch in batches:
        for row in batch.to_pylist():
            name = f"{path}/{row['file']}"
            rows, held, seen = [], 0, 0
            with (system.open_input_stream(f"{name}.rec", buffer_size=BUFFER) as data,
                  system.open_input_stream(f"{name}.idx", buffer_size=BUFFER) as index):
                while (payload := read_frame(data)) is not None:
                    is_null, position, width = NOTE.unpack_from(payload)
                    ids = np.frombuffer(payload, f"<u{width}", offset=NOTE.size)
                    _, before, count = ENTRY.unpack(index.read(ENTRY.size))
                    if count != len(ids):
                        raise ValueError(f"{name}: index and records differ")
                    raw = ids.astype("<u4").tobytes()
                    rows.append((row["part"], None if is_null else position, before, count, raw))
                    held, seen = held + len(raw), seen + 1
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if seen != row["n_records"]:
                raise ValueError(f"{name}: {seen} records, {row['n_records']} expected")
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Read record files back, checking every frame.

    Columns: position, start (ids of all notes before it), n_tokens, token_bytes (its ids as
    little-endian 32-bit integers). A damaged or missing record raises.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row per file of about a gigabyte of notes: the running total is over files, not notes.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    n_files = max(1, manifest.count())
    notes = (
        manifest.select("part", "file", "n_records").repartitionByRange(n_files, "part")
        .mapInArrow(lambda b: _read(b, folder),
                    "part int, position long, in_file long, n_tokens long, token_bytes binary")
    )
    # The base of a file: as small as the list of files that Spark itself plans a scan with.
    return notes.join(F.broadcast(files.select("part", "base")), "part").select(
        "position", (F.col("base") + F.col("in_file")).alias("start"), "n_tokens", "token_bytes"
    )


def read_record(folder: str, file: str, record: int) -> tuple[int | None, np.ndarray]:
    """One record by its number in a file, through the index: position and ids."""
    system, path = open_folder(folder)
    with system.open_input_file(f"{path}/{file}.idx") as index:
        index.seek(record * ENTRY.size)
        offset, _, _ = ENTRY.unpack(index.read(ENTRY.size))
    with system.open_input_file(f"{path}/{file}.rec") as data:
        data.seek(offset)
        payload = read_frame(data)
    is_null, position, width = NOTE.unpack_from(payload)
    return None if is_null else position, np.frombuffer(payload, f"<u{width}", offset=NOTE.size)
