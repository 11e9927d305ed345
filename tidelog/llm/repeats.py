"""Remove passages that occur earlier in the corpus: exact, by a count-min prefilter and a second pass.

A window is a run of consecutive words of one document. A first pass sketches the counts of all windows. The second pass
groups exactly, by hashes of 96 bits throughout, those windows alone that the sketch estimates as repeated: estimates are never too low,
so none is lost. A chunk sends each of its distinct windows once, its first place, so a passage that all documents share meets as
one row per chunk. Words covered by a window that starts earlier elsewhere are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.chunks import chunk_table, text_bytes
from tidelog.llm.sketch import SharedCells, dealt, packed, shard_count, shared_cells, width_bits
from tidelog.llm.storage import Scope
from tidelog.llm.words import Words, buffers, rolling, words_of

FIRST = np.iinfo(np.int64).min
PLACES_SCHEMA = "part int, chunk long, messages array<struct<shard:int,h:binary,h2:binary,doc:binary,pos:binary>>"


def _narrow(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, after one byte that says how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(a) or int(a.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + a.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64)


def _in_order(chunk: pa.Table) -> pa.Table:
    """Rows by id, null first, and then by text."""
    return chunk.take(pc.sort_indices(chunk, sort_keys=[("id", "ascending"), ("content", "ascending")], null_placement="at_start"))


def _windows(texts: pa.ChunkedArray, size: int) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, words, hash and further hash of each window, its first word) of runs of texts."""
    for i, j, words in words_of(texts):
        hashes, starts = words.windows(size)
        yield i, j, words, hashes, rolling(words.hashes, starts, starts + size, 29).astype(np.uint32), starts


def _after_first(h: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether a window of the same hashes stands before."""
    again = np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    same, same2 = np.diff(h[order]) == 0, np.diff(h2[order].astype(np.int64)) == 0
    if (same & ~same2).any():  # different windows share the first hash
        order = np.lexsort((h2, h))
        same, same2 = np.diff(h[order]) == 0, np.diff(h2[order].astype(np.int64)) == 0
    again[order[1:]] = same & same2
    return again


def _among(h: np.ndarray, h2: np.ndarray, known: np.ndarray, known2: np.ndarray) -> np.ndarray:
    """Whether a window's hashes are among known ones."""
    if not len(known):
        return np.zeros(len(h), bool)
    order = np.lexsort((known2, known))
    known, known2 = known[order], known2[order]
    at = np.searchsorted(known, h)
    found, left = np.zeros(len(h), bool), np.flatnonzero(at < len(known))
    while len(left):  # once, but where different windows share the first hash
        left = left[known[at[left]] == h[left]]
        same = known2[at[left]] == h2[left]
        found[left[same]] = True
        left = left[~same]
        at[left] += 1
        left = left[at[left] < len(known)]
    return found


def _kept(words: list[bytes], keep: np.ndarray) -> bytes:
    return b" ".join(words) if keep.all() else b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", scope: Scope | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (the words kept, joined by one space), replacing columns of these names.

    A word is removed if a window of ``window`` words that covers it has a word sequence that also starts earlier: at a smaller id, or in the same
    document before. Ids must be integers; a null id is below all others. Rows that share an id follow each other by text (equal rows, or such
    rows in distant parts of the input, in an order fixed by where they are stored), so one of repeated rows keeps its words. A null or empty text has no words
    and ``kept_text`` is empty. No rows give no rows. Other columns keep their values, whatever their names.
    """
    scope = Scope.of(scope, docs)
    added = ["n_words", "n_removed", "kept_text"]
    columns = [c for c in docs.columns if c not in added]
    rest = [c for c in columns if c != text_col or docs.schema[c].dataType.simpleString() != "string"]
    total = text_bytes(docs, text_col)
    chunks = chunk_table(docs, F.col(f"`{text_col}`").cast("string"), id_col, total, scope, rest)
    bits, shards = width_bits(total), shard_count(total)

    def keys(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, words in words_of(texts):
            yield words.windows(window)[0]

    def places(rows: pa.Table, returned: pa.Table) -> pa.Table:
        shared = SharedCells(returned, bits)
        number = rows["chunk"][0].as_py() if rows.num_rows else 0
        rows = _in_order(rows)
        ids = rows["id"].fill_null(FIRST).to_numpy()
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for i, j, words, h, h2, starts in _windows(rows["content"], window):
            here = shared.of(h) > 0
            starts = starts[here]
            doc = np.searchsorted(words.at, starts, side="right") - 1
            found.append((h[here], h2[here], ids[i:j][doc], (starts - words.at[doc]).astype(np.uint32)))
        h, h2, doc, pos = (np.concatenate(x) for x in zip(*found))
        at_first = ~_after_first(h, h2)
        h, h2, doc, pos = h[at_first], h2[at_first], doc[at_first].astype(np.uint64), pos[at_first]
        edges = (np.arange(1, shards, dtype=np.float64) * (2.0**64 / shards)).astype(np.uint64)
        shard = np.searchsorted(edges, h, side="right")
        order = np.argsort(shard, kind="stable")  # by document within a shard, so that steps from one to the next are small
        at = np.searchsorted(shard[order], np.arange(shards + 1))
        full = np.flatnonzero(np.diff(at))
        cut = lambda x, write: pa.array([write(x[order[at[s] : at[s + 1]]]) for s in full], pa.binary())
        steps = lambda x: _narrow(x[:1]) + _narrow(np.diff(x))
        return pa.Table.from_batches([packed(number, full, shards, h=cut(h, np.ndarray.tobytes), h2=cut(h2, np.ndarray.tobytes), doc=cut(doc, steps), pos=cut(pos, _narrow))])

    def later(shard: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in shard[c].to_pylist()]
        parts = read("h", np.uint64)
        number = shard["chunk"].to_numpy()
        h, h2 = np.concatenate(parts), np.concatenate(read("h2", np.uint32))
        doc = np.concatenate([np.cumsum(np.concatenate([_wide(x[: 1 + x[0]]), _wide(x[1 + x[0] :])]), dtype=np.uint64) for x in shard["doc"].to_pylist()]).astype(np.int64)
        pos = np.concatenate([_wide(x) for x in shard["pos"].to_pylist()])
        at = np.cumsum([0, *map(len, parts)])
        order = np.lexsort((np.repeat(number, np.diff(at)), pos, doc, h2, h))
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        out = [(n, h[i:j][again[i:j]].tobytes(), h2[i:j][again[i:j]].tobytes()) for n, i, j in zip(number.tolist(), at, at[1:]) if again[i:j].any()]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "h": pa.array([x[1] for x in out], pa.binary()), "h2": pa.array([x[2] for x in out], pa.binary())})

    def remove(rows: pa.Table, returned: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        joined = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in returned[c].to_pylist())])
        pieces = [(i, j, words.counts(), h, h2, starts) for i, j, words, h, h2, starts in _windows(rows["content"], window)]
        every, every2 = (np.concatenate([np.zeros(0, kind), *(p[k] for p in pieces)]) for k, kind in ((3, np.uint64), (4, np.uint32)))
        again = _after_first(every, every2) | _among(every, every2, joined("h", np.uint64), joined("h2", np.uint32))
        n_words, n_removed, kept, at = [], [], [], 0
        data, offsets = buffers(rows["content"])
        for i, j, counts, hashes, _, starts in pieces:
            starts = starts[again[at : at + len(hashes)]]
            at += len(hashes)
            change = np.zeros(int(counts.sum()) + window + 1, np.int32)
            change[starts] += 1
            change[starts + window] -= 1
            keep = np.cumsum(change) == 0
            ends = np.cumsum(counts).tolist()
            for k, n, end in zip(range(i, j), counts.tolist(), ends):
                own = keep[end - n : end]
                n_words.append(n)
                n_removed.append(n - int(np.count_nonzero(own)))
                kept.append(_kept(data[offsets[k] : offsets[k + 1]].tobytes().split(), own))
        return pa.table({**{c: rows[c] for c in passed}, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    shared = shared_cells(chunks, keys, total)
    found = chunks.select("chunk", "id", "content").groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(places, PLACES_SCHEMA)
    removed = dealt(found, shards).applyInArrow(later, "chunk long, h binary, h2 binary")
    passed = ["content", *(["rest"] if rest else [])]
    schema = T.StructType([*(chunks.schema[c] for c in passed), *(T.StructField(c, T.LongType()) for c in added[:2]), T.StructField(added[2], T.StringType())])
    out = chunks.select("chunk", "id", *passed).groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInArrow(remove, schema)
    return out.select(*[(F.col("rest")[c] if c in rest else F.col("content")).alias(c) for c in columns], *added)
