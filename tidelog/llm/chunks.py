"""Documents as a bucketed table of chunks, so that later passes over the texts need no shuffle of them.

Two-pass operators must meet the same documents again with what was learned about them. Each input partition is rewritten
where it is read, in chunks of neighbouring rows, and bucketed by chunk number; a pass that brings something back for a chunk
moves only that. A chunk is cut by bytes, so what a task holds at once is bounded however long the texts are: a text that is longer than a
chunk has one of its own, or the end of one. Chunks grow with the square root of the corpus, as there is a message from each to each shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.storage import Scope

#: Text of a chunk: what a pass holds in memory at once.
LEAST_CHUNK, MOST_CHUNK = 2 << 20, 64 << 20
#: Text in a bucket, about, and the most buckets that Spark's defaults take kindly to. A bucket is what a task reads; it holds a chunk of that at once.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 50_000


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.select(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0


def chunk_bytes(total_bytes: int) -> int:
    return min(MOST_CHUNK, max(LEAST_CHUNK, math.isqrt(total_bytes << 10)))


class Cutter:
    """Cuts the rows of one partition, as they come, into chunks of about ``limit`` bytes; a chunk is named by its first row."""

    def __init__(self, limit: int):
        self.limit, self.held, self.chunk = limit, 0, -1

    def cut(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0, np.int64)
        ends = self.held + np.cumsum(sizes)
        slot = np.maximum(ends - 1, 0) // self.limit
        first = np.diff(slot, prepend=max(self.held - 1, 0) // self.limit) != 0
        first[0] |= self.chunk < 0
        at = np.maximum.accumulate(np.where(first, np.arange(len(rows)), -1))
        out = np.where(at >= 0, rows[at], self.chunk)
        self.held, self.chunk = int(ends[-1]), int(out[-1])
        return out


def _numbers(limit: int) -> Column:
    """The chunk of each row. Rows and sizes alone go through Python, in the order of the partition."""

    @F.arrow_udf("long")
    def number(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cutter = Cutter(limit)
        for rows, sizes in batches:
            yield pa.array(cutter.cut(rows.to_numpy(), sizes.to_numpy()), pa.int64())

    return number.asNondeterministic()("row", "size")


def bucket_count(total_bytes: int) -> int:
    return min(MOST_BUCKETS, max(24, -(-total_bytes // BUCKET_BYTES)))


def chunk_table(docs: DataFrame, content: Column, id_col: str, total_bytes: int, scope: Scope, rest: list[str]) -> DataFrame:
    """``(chunk long, row long, id long, content, rest)`` of ``docs``, as a table in the shared folder that is bucketed by chunk.

    ``row`` is a number of its own for each row. ``rest`` has the columns of that name in a struct, where none can clash; it is left out if there are none.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), content.alias("content"), *kept)
    rows = rows.withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))
    return scope.bucketed(rows.withColumn("chunk", _numbers(chunk_bytes(total_bytes))).drop("size"), bucket_count(total_bytes), "chunk", "chunks")
