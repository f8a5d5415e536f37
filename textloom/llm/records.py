"""Length-delimited binary records of token ids, with a separate offset index.

A file is a run of frames; a frame is

    length of the payload   8 bytes, little-endian
    masked CRC-32 of those  4 bytes, little-endian
    payload                 document id (8 bytes, signed), flag (1 byte: 1 where the id is null), width (1 byte: 2 or 4),
                            then the ids, little-endian, width bytes each
    masked CRC-32 of it     4 bytes, little-endian
    line feed               1 byte

A CRC is masked by turning it right by 15 bits and adding 0xa282ead8, so that a checksum of data that holds checksums
stays sound. Spark's text writer writes the frames (the line feed is its row end), so files are committed as any other
output of Spark's is, in whatever store the shared folder is; a lost executor leaves no half file. Frames are handed to the
writer in slabs, and a file has a fixed number of slabs: so its size follows bytes, not rows.

Below the path given, "records" holds the files and "index" the offset index.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_chunks, materialize, text_or_empty
from textloom.llm.store import open_input
from textloom.llm.tokenization import encoder

CHUNK_BYTES = 1 << 20
#: Bytes of text to a task, and of frames to a file; a file is read whole, so this bounds a reading task's memory (one
#: longer record apart).
FILE_BYTES = 24 << 20
#: Bytes of frames to a slab.
SLAB_BYTES = 1 << 20
#: Files up to which the table of file starts (16 bytes each) is broadcast.
BROADCAST_FILES = 100_000
#: Files that a shuffled reader keeps open.
OPEN_FILES = 64
HEAD = struct.Struct("<QI")
PAYLOAD_HEAD = struct.Struct("<qBB")


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, mask(zlib.crc32(length)).to_bytes(4, "little"), payload, mask(zlib.crc32(payload)).to_bytes(4, "little"), b"\n"))


def frame_at(data: bytes | memoryview, offset: int) -> tuple[memoryview, int]:
    """The payload of the frame at offset, and where the next one starts. Raises ValueError on any damage."""
    view = memoryview(data)
    if len(view) - offset < HEAD.size:
        raise ValueError(f"cut off at {offset}")
    length, check = HEAD.unpack_from(view, offset)
    if mask(zlib.crc32(view[offset : offset + 8])) != check:
        raise ValueError(f"bad length at {offset}")
    start, end = offset + HEAD.size, offset + HEAD.size + length
    if len(view) < end + 5:
        raise ValueError(f"cut off at {offset}")
    if mask(zlib.crc32(view[start:end])) != int.from_bytes(view[end : end + 4], "little"):
        raise ValueError(f"bad payload at {offset}")
    return view[start:end], end + 5


@dataclass(frozen=True)
class Record:
    doc_id: int | None
    ids: np.ndarray


def to_payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return PAYLOAD_HEAD.pack(doc_id or 0, doc_id is None, width) + ids.astype("<u2" if width == 2 else "<u4").tobytes()


def from_payload(payload: bytes | memoryview) -> Record:
    doc_id, none, width = PAYLOAD_HEAD.unpack_from(payload)
    return Record(None if none else doc_id, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=PAYLOAD_HEAD.size))


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, slab_bytes: int = SLAB_BYTES) -> None:
    """Writes the ids of each whole text (null: empty) and end_id below path, in ascending order of (id_col, content).

    Null ids come first. Files are ranges of that order, in the order of their part and roll numbers; none is larger than
    file_bytes by more than a slab or one record. Rows with equal ids are ordered, and dealt out, by their content; equal
    rows count as many times as they are there.
    """
    sized = docs.select(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0
    tasks = max(1, -(-sized // file_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(int(tasks), "id", "tie").sortWithinPartitions("id", "tie")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        width = 2 if own.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        slab, held = [], 0
        # a slab goes without its last line feed, the row end, which the writer adds
        made = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(slab)[:-1]], pa.binary())], names=["frame"])
        for batch in arrow_chunks(batches, "text", CHUNK_BYTES):
            ids, ends = own.encode(batch.column("text"))
            for d, a, b in zip(batch.column("id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                one = frame(to_payload(d, np.append(ids[a:b], np.uint32(end_id)), width))
                if slab and held + len(one) > slab_bytes:
                    yield made()
                    slab, held = [], 0
                slab.append(one)
                held += len(one)
        if slab:
            yield made()

    slabs = ordered.select("id", "text").mapInArrow(framed, "frame binary").select(F.col("frame").cast("string").alias("value"))
    slabs.write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, file_bytes // slab_bytes)).text(f"{path}/records")


INDEX = "file string, part int, roll int, n long, file_offset long, frame_length long, doc_id long, tokens_before long, n_tokens long, ids_crc32 long"


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files below path, read whole and checked: file (its name), part and roll (its place
    among the files), n (from 0), file_offset, frame_length, doc_id, tokens_before (in that file), n_tokens, ids_crc32.
    Fails on a damaged file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                file = name.rsplit("/", 1)[1]
                place = re.match(r"part-(\d+)(?:.*-c(\d+))?", file)
                part, roll = int(place[1]), int(place[2] or 0)
                data, at, rows, before = memoryview(content.as_buffer()), 0, [], 0
                while at < len(data):
                    payload, after = frame_at(data, at)
                    record = from_payload(payload)
                    rows.append((file, part, roll, len(rows), at, after - at, record.doc_id, before, len(record.ids), zlib.crc32(record.ids.astype("<u4"))))
                    before += len(record.ids)
                    at = after
                columns = list(zip(*rows)) or [[]] * 10
                types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select("path", "content")
    return files.mapInArrow(read, INDEX)


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of the records below path, written beside them: scan_records' columns and start, the ids of all
    records before this one. fetch reads by it, in any order."""
    rows = materialize(scan_records(spark, path), "record-scan")
    totals = rows.groupBy("part", "roll").agg(F.sum("n_tokens").alias("tokens"))
    # One row a file.
    starts = totals.select("part", "roll", F.coalesce(F.sum("tokens").over(Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    if totals.count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    rows.join(starts, ["part", "roll"]).withColumn("start", F.col("file_start") + F.col("tokens_before")).drop("file_start").write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def fetch(path: str, rows: Iterable[tuple[str, int, int]]) -> Iterator[Record]:
    """The records of index rows (file, file_offset, frame_length) in the order given, one seek each. Files stay open
    while they are used, so many at a time."""
    held: dict[str, BinaryIO] = {}
    try:
        for file, offset, length in rows:
            if file not in held:
                if len(held) >= OPEN_FILES:
                    held.pop(next(iter(held))).close()
                held[file] = open_input(f"{path}/records/{file}")
            held[file].seek(offset)
            yield from_payload(frame_at(held[file].read(length), 0)[0])
    finally:
        for f in held.values():
            f.close()


def read_records(index: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of the rows of an index, or of any part of it, in the order that each of its partitions has."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(fetch(path, zip(*(part.column(c).to_pylist() for c in ("file", "file_offset", "frame_length")))))
                yield pa.RecordBatch.from_arrays([pa.array([r.doc_id for r in found], pa.int64()), pa.array([r.ids.astype(np.int32) for r in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return index.select("file", "file_offset", "frame_length").mapInArrow(read, "doc_id long, ids array<int>")
