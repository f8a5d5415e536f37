"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

The next example of a sequence is the fitting one whose demand has the greatest dot product with what the sequence has
left, both as shares of the limits. What no example fills is filled by cutting one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textloom.llm.common import arrow_chunks, text_or_empty
from textloom.llm.tokenization import encoder

CHUNK_BYTES = 1 << 20
#: Tokens that are packed together; a task's memory depends on this, not on its rows.
BLOCK_TOKENS = 4 << 20
#: No cut leaves a piece shorter than this in a sequence that has room for less.
LEAST_PIECE = 8


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss_tokens: int = 1024


@dataclass(frozen=True)
class Piece:
    example: int
    start: int
    length: int
    sequence: int
    offset: int


def place(tokens: np.ndarray, loss_from: np.ndarray, limits: Limits) -> list[Piece]:
    """Pieces that hold each token of each example once. Tokens of an example from loss_from on bear loss.

    Examples over a limit are first cut into pieces within it. Examples with equal demands are alike; of those the
    first in input order goes first.
    """
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("limits must be positive")
    pieces: list[Piece] = []
    sequence = 0
    waiting: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def demand(example: int, start: int, length: int) -> tuple[int, int]:
        return length, max(0, start + length - max(start, int(loss_from[example])))

    def wait(example: int, start: int, length: int) -> None:
        waiting.setdefault(demand(example, start, length), []).append((example, start))

    def longest(example: int, start: int, length: int, room: int, loss_room: int) -> int:
        """How many tokens from start on fit."""
        free = max(0, int(loss_from[example]) - start)
        return min(length, room, free + loss_room)

    for example, n in enumerate(tokens.tolist()):
        start = 0
        while n - start > 0:
            fits = longest(example, start, n - start, limits.tokens, limits.loss_tokens)
            if fits == n - start:
                break
            pieces.append(Piece(example, start, fits, sequence, 0))
            sequence += 1
            start += fits
        if n - start == limits.tokens:
            pieces.append(Piece(example, start, n - start, sequence, 0))
            sequence += 1
        elif n > start:
            wait(example, start, n - start)
    for queue in waiting.values():
        queue.reverse()

    scale = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
    classes = np.array(sorted(waiting), dtype=np.int64).reshape(-1, 2)
    demands = np.column_stack([classes[:, 0], np.ones(len(classes), np.int64), classes[:, 1]]) if len(classes) else np.zeros((0, 3), np.int64)
    shares, here = demands / scale, np.ones(len(classes), dtype=bool)
    index = {tuple(c): i for i, c in enumerate(classes.tolist())}
    left_over = sum(map(len, waiting.values()))

    def put_back(example: int, start: int, length: int) -> None:
        nonlocal demands, shares, here, left_over
        key = demand(example, start, length)
        if key not in index:
            index[key] = len(demands)
            demands = np.vstack([demands, [key[0], 1, key[1]]])
            shares, here = demands / scale, np.append(here, True)
        waiting.setdefault(key, []).append((example, start))
        here[index[key]] = True
        left_over += 1

    def take(i: int) -> tuple[int, int, int]:
        nonlocal left_over
        key = (int(demands[i, 0]), int(demands[i, 2]))
        example, start = waiting[key].pop()
        here[i] = bool(waiting[key])
        left_over -= 1
        return example, start, key[0]

    while left_over:
        room = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.int64)
        offset = 0
        while left_over:
            fits = here & (demands <= room).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, shares @ (room / scale), -1.0)))
                example, start, length = take(i)
            elif room[0] >= LEAST_PIECE and room[1] >= 1:
                # nothing fits whole: cut the longest one that waits
                i = int(np.argmax(np.where(here, demands[:, 0], -1)))
                example, start, whole = take(i)
                length = longest(example, start, whole, int(room[0]), int(room[2]))
                if length < 1:
                    put_back(example, start, whole)
                    break
                put_back(example, start + length, whole - length)
            else:
                break
            pieces.append(Piece(example, start, length, sequence, offset))
            offset += length
            room -= np.array([length, 1, demand(example, start, length)[1]])
            if room[0] <= 0 or room[1] <= 0:
                break
        sequence += 1
    return pieces


SCHEMA = "id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_texts(docs: DataFrame, tokenizer_path: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", prompt_tokens_col: str | None = None) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    An example is the ids of one text (a null one counts as empty), with no special tokens added, and end_id. All its
    tokens bear loss, or all after the first prompt_tokens_col (null: none). Each task packs its own rows, BLOCK_TOKENS
    at a time: no shuffle, and at most one sequence a block is left with room. sequence_id holds the task's partition
    and a running number. Null and repeated ids are examples like any other; no rows give no pieces.
    """
    from pyspark.sql import functions as F

    kind = docs.schema[id_col].dataType
    prompt = F.coalesce(F.col(prompt_tokens_col).cast("long"), F.lit(0)) if prompt_tokens_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), prompt.alias("prompt"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sequence = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        tail = end_id.to_bytes(4, "little")
        ids, encoded, prompts, held = [], [], [], 0
        id_type = None

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            counts = np.array([len(x) // 4 for x in encoded], dtype=np.int64)
            pieces = place(counts, np.array(prompts, dtype=np.int64), limits)
            crcs = [zlib.crc32(memoryview(encoded[p.example])[4 * p.start : 4 * (p.start + p.length)]) for p in pieces]
            numbers = np.array([(p.example, p.start, p.length, p.sequence, p.offset) for p in pieces], dtype=np.int64).reshape(-1, 5)
            made = [pa.concat_arrays(ids).take(pa.array(numbers[:, 0])), pa.array(numbers[:, 1]), pa.array(numbers[:, 2]), pa.array(crcs, pa.int64()), pa.array(counts[numbers[:, 0]]), pa.array(numbers[:, 3] + sequence), pa.array(numbers[:, 4])]
            sequence += int(numbers[:, 3].max()) + 1 if len(numbers) else 0
            return pa.RecordBatch.from_arrays(made, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in arrow_chunks(batches, "text", CHUNK_BYTES):
            id_type = batch.column("id").type
            found, ends = own.encode(batch.column("text"))
            new = [found[a:b].tobytes() + tail for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            ids.append(batch.column("id").cast(id_type))
            encoded += new
            prompts += batch.column("prompt").to_pylist()
            held += sum(map(len, new)) // 4
            if held >= BLOCK_TOKENS:
                yield flush()
                ids, encoded, prompts, held = [], [], [], 0
        if encoded:
            yield flush()

    return rows.mapInArrow(packed, SCHEMA.format(id=kind.simpleString())).withColumnRenamed("id", id_col)
