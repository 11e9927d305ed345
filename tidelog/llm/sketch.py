"""Count-min sketches of 64-bit keys that are merged in shards and grow with the corpus.

A sketch is one row of counters, far wider than the number of keys: about ``CELLS_PER_BYTE`` cells for a byte of text. So
wide a row is nearly empty in each chunk of documents, and is sent as its sorted cells with their counts, at about two bytes a
key. A shard is a range of cells; merging adds the chunks' counts, which a chunk cuts at 255. So a merged count is one only if a single key of
the cell occurs, and once; above that it says how common a key is, and decides nothing but an order. Each chunk gets back those of its own cells that
count two or more: nothing is broadcast and nothing passes through the driver.

Shards are dealt to a bounded number of tasks. A chunk sends one message to each, with what it has for the task's shards; the task merges one shard after another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.chunks import MOST_CHUNK, chunk_bytes

CELLS_PER_BYTE = 3
SKETCH_SCHEMA = "part int, chunk long, messages array<struct<shard:int,cells:binary,counts:binary>>"
SHARED_SCHEMA = "chunk long, cells binary, codes binary"
#: Tasks that shards are dealt to, at most.
MOST_PARTS = 20_000
#: Keys of a run of texts: they may repeat, and each occurrence counts.
Keys = Callable[[pa.Array], Iterable[np.ndarray]]


def width_bits(total_bytes: int) -> int:
    return max(24, math.ceil(math.log2(CELLS_PER_BYTE * total_bytes + 1)))


def shard_count(total_bytes: int) -> int:
    """How many shards hold the cells, or windows, of the corpus: each for the text of some chunks, so that both ends of a message grow together."""
    return max(24, -(-total_bytes // min(MOST_CHUNK, 4 * chunk_bytes(total_bytes))))


def shards_of_part(shards: int) -> int:
    return -(-shards // MOST_PARTS)


def packed(chunk: int, full: list[int] | np.ndarray, shards: int, **columns: pa.Array) -> pa.RecordBatch:
    """What a chunk has for shards, in their order, as one row for each part: ``part, chunk, messages``."""
    part = np.asarray(full, np.int64) // shards_of_part(shards)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    values = pa.StructArray.from_arrays([pa.array(full, pa.int32()), *columns.values()], ["shard", *columns])
    messages = pa.ListArray.from_arrays(pa.array(np.append(first, len(part)), pa.int32()), values)
    return pa.record_batch({"part": pa.array(part[first], pa.int32()), "chunk": pa.array([chunk] * len(first), pa.int64()), "messages": messages})


def dealt(sent: DataFrame, shards: int):
    """Rows of :func:`packed` grouped by ``part`` and ``shard``, with one shuffle; each part is a task's."""
    parts = -(-shards // shards_of_part(shards))
    return sent.repartitionById(parts, "part").select("part", "chunk", F.explode("messages").alias("m")).select("part", "chunk", "m.*").groupBy("part", "shard")


def cells_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits)


def encode(cells: np.ndarray) -> bytes:
    """Sorted distinct numbers as steps of two or four bytes; a step that is too long is split by marks of the largest value."""
    if not len(cells):
        return b""
    steps = np.diff(cells, prepend=np.uint64(0))
    kind = np.uint16 if len(cells) > 1 and int(cells[-1] - cells[0]) // (len(cells) - 1) < 40_000 else np.uint32
    most = np.uint64(np.iinfo(kind).max)
    marks = (steps // most).astype(np.int64)
    if marks.any():
        out = np.full(len(steps) + int(marks.sum()), most, np.uint64)
        out[np.arange(len(steps)) + np.cumsum(marks)] = steps % most
        steps = out
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    kind = np.uint16 if data[0] == 2 else np.uint32
    steps = np.frombuffer(data, kind, offset=1)
    return np.cumsum(steps, dtype=np.uint64)[steps != np.iinfo(kind).max]


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.ChunkedArray]]:
    """The contents of each chunk, from rows in the order of chunks."""
    held: list[pa.Array] = []
    number = None
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        at = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for i, j in zip(at, at[1:]):
            if j > i:
                if held and chunk[i] != number:
                    yield number, pa.chunked_array(held)
                    held = []
                number = int(chunk[i])
                held.append(batch.column("content").slice(i, j - i))
    if held:
        yield number, pa.chunked_array(held)


def shared_cells(chunks: DataFrame, keys: Keys, total_bytes: int) -> DataFrame:
    """For each chunk, rows of the cells of its keys that count two or more in all, with ``codes`` for how many.

    ``codes`` has a byte per cell, rising with the merged count and equal wherever the cell is met.
    """
    bits, shards = width_bits(total_bytes), shard_count(total_bytes)

    def partition_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, shards, dtype=np.float64) * (2.0**bits / shards)).astype(np.uint64)
        for chunk, content in by_chunk(batches):
            found = [cells_of(k, bits) for part in content.chunks for k in keys(part)]
            cells, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            counts = np.minimum(counts, 255).astype(np.uint8)
            at = [0, *np.searchsorted(cells, edges).tolist(), len(cells)]
            full = [s for s in range(shards) if at[s + 1] > at[s]]
            if full:
                own = lambda write: pa.array([write(slice(at[x], at[x + 1])) for x in full], pa.binary())
                yield packed(chunk, full, shards, cells=own(lambda x: encode(cells[x])), counts=own(lambda x: counts[x].tobytes()))

    def merge(shard: pa.Table) -> pa.Table:
        parts = [decode(x) for x in shard["cells"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in shard["counts"].to_pylist()]).astype(np.int64)
        cells = np.concatenate(parts)
        order = np.argsort(cells, kind="stable")
        first = np.flatnonzero(np.diff(cells[order], prepend=cells[order[0]] + np.uint64(1)) != 0)
        total = np.add.reduceat(counts[order], first)
        code = np.minimum(255, np.floor(8 * np.log2(total))).astype(np.uint8)
        codes = np.empty(len(cells), np.uint8)
        codes[order] = np.repeat(code, np.diff(first, append=len(cells)))
        at = np.cumsum([0, *map(len, parts)])
        out = [(chunk, encode(p[c > 0]), c[c > 0].tobytes()) for chunk, p, c in ((chunk, p, codes[i:j]) for chunk, p, i, j in zip(shard["chunk"].to_pylist(), parts, at, at[1:])) if c.any()]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "cells": pa.array([x[1] for x in out], pa.binary()), "codes": pa.array([x[2] for x in out], pa.binary())})

    # A bucket's files are read one after another; sorted, a chunk's rows are together.
    sketches = chunks.select("chunk", "content").sortWithinPartitions("chunk").mapInArrow(partition_sketches, SKETCH_SCHEMA)
    return dealt(sketches, shards).applyInArrow(merge, SHARED_SCHEMA)


class SharedCells:
    """What a chunk got back: its cells that count two or more."""

    def __init__(self, returned: pa.Table, bits: int):
        parts = sorted(((decode(a), np.frombuffer(b, np.uint8)) for a, b in zip(returned["cells"].to_pylist(), returned["codes"].to_pylist())), key=lambda x: x[0][0])
        self.bits = bits
        self.cells = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.uint64)
        self.codes = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, np.uint8)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key: 0 where it occurs once."""
        if not len(self.cells) or not len(keys):
            return np.zeros(len(keys), np.uint8)
        cells = cells_of(keys, self.bits)
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        return np.where(self.cells[at] == cells, self.codes[at], 0).astype(np.uint8)
