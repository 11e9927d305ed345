"""Near-duplicate documents by the Jaccard similarity of their word n-grams, exactly.

The incidence of documents by n-grams is built in two passes over chunks of documents. The first sketches how many documents
have each n-gram; the second keeps, of each document, the n-grams that may be met elsewhere, and leaves out documents of
which too few are. Equal sets become one; the rest is a blocked sparse product (:mod:`tidelog.llm.setjoin`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.chunks import chunk_table, text_bytes
from tidelog.llm.setjoin import linked_components
from tidelog.llm.sketch import SharedCells, shared_cells, width_bits
from tidelog.llm.storage import Scope
from tidelog.llm.words import rolling, words_of

SETS_SCHEMA = "row long, chunk long, id long, n_items long, digest binary, n long, shared long, score int, items array<long>"
#: The sorted distinct hashes that make the set of each content of a chunk.
Sets = Callable[[pa.Array], Iterator[np.ndarray]]


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the n-grams of each text; of all its words as one, if they are fewer."""
    for _, _, words in words_of(texts, lower=True):
        hashes, starts = words.windows(size)
        at = np.searchsorted(starts, words.at)
        counts = words.counts()
        short = np.flatnonzero((counts > 0) & (counts < size))
        whole = dict(zip(short.tolist(), rolling(words.hashes, words.at[short], words.at[short + 1], 31)))
        for k in range(len(counts)):
            yield np.array([whole[k]], np.uint64) if k in whole else np.unique(hashes[at[k] : at[k + 1]])


def document_sets(chunks: DataFrame, sets_of: Sets, total_bytes: int, num: int, den: int) -> DataFrame:
    """A row for each document; ``digest`` and what follows is null if nothing can be similar to it, ``items`` also for copies within a chunk."""
    bits = width_bits(total_bytes)

    def sets(rows: pa.Table, returned: pa.Table) -> pa.Table:
        shared = SharedCells(returned, bits)
        rows = rows.sort_by("row")
        seen: set[bytes] = set()
        out: dict[str, list] = {c: [] for c in ("n_items", "digest", "n", "shared", "score", "items")}
        for contents in rows["content"].chunks:
            for own in sets_of(contents):
                n = len(own)
                codes = shared.of(own)
                m = int(np.count_nonzero(codes))
                row = [n, None, None, None, None, None]
                if n and den * m >= num * n:
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    row[1] = digest
                    if digest not in seen:
                        seen.add(digest)
                        order = np.lexsort((own, codes))[n - m :]
                        row[2:] = [n, m, int(16 * codes.mean()), own[order].view(np.int64)]
                for c, x in zip(out, row):
                    out[c].append(x)
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        return pa.table({"row": rows["row"], "chunk": rows["chunk"], "id": rows["id"], **{c: pa.array(out[c], t) for c, t in zip(out, types)}})

    shared = shared_cells(chunks, sets_of, total_bytes)
    return chunks.select("chunk", "row", "id", "content").groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(sets, SETS_SCHEMA)


def labelled_rows(rows: DataFrame, num: int, den: int, scope: Scope, banded: bool = False) -> DataFrame:
    """``(row, chunk, id, n_items, digest, label, keep)`` of the rows of :func:`document_sets`, stored.

    ``label`` is the smallest id of its component, null for documents without links; ``keep`` is the row that stands for the component.
    """
    # Ids in order, null last; the row decides between equal ids.
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"), F.min(F.struct(F.isnull("id"), "id", "row")).alias("best"))
    classes = scope.stored(classes, "classes")
    sets = rows.where("items IS NOT NULL").join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "shared", "score", "items")
    sets = scope.stored(sets, "distinct_sets")
    linked = linked_components(sets, num, den, banded, scope)
    named = scope.stored(classes.join(linked, "node", "left").select("digest", "best", F.coalesce("component", "node").alias("component")), "named")
    scope.drop(classes, sets)
    # Stored, so that what a large component has is split between tasks.
    tops = scope.stored(named.groupBy("component").agg(F.min("best").alias("top")), "tops")
    named = named.join(tops, "component").select("digest", F.col("top.id").alias("label"), F.col("top.row").alias("keep"))
    return rows.select("row", "chunk", "id", "n_items", "digest").join(named, "digest", "left")


def _labelled(docs: DataFrame, size: int, num: int, den: int, id_col: str, text_col: str, rest: list[str], scope: Scope) -> tuple[DataFrame, DataFrame]:
    """The chunks of ``docs`` and :func:`labelled_rows` of their shingles."""
    total = text_bytes(docs, text_col)
    chunks = chunk_table(docs, F.col(f"`{text_col}`").cast("string"), id_col, total, scope, rest)
    rows = scope.stored(document_sets(chunks, lambda texts: shingle_sets(texts, size), total, num, den), "sets")
    if not rest:
        scope.drop(chunks)
    return chunks, labelled_rows(rows, num, den, scope)


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text", scope: Scope | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    Words are lower-cased (A-Z) and split at ASCII white space. Documents link when den * intersection >= num * union of their sets of
    ``size``-word shingles; the component id is the smallest id reachable. A null or empty text has no shingles and no links; its component is its own
    id. Ids must be integers; null ids are above all others, so a component is null only if all its ids are. Repeated rows are all returned, with
    the same component. No rows give no rows; other columns are left out.
    """
    _, rows = _labelled(docs, size, num, den, id_col, text_col, [], Scope.of(scope, docs))
    return rows.select(F.col("id").alias("doc_id"), F.col("n_items").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text", scope: Scope | None = None) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and of repeated rows one. Columns keep their values, whatever their names."""
    # The text is read from ``content``, unless the cast to it has changed it.
    rest = [c for c in docs.columns if c != text_col or docs.schema[c].dataType.simpleString() != "string"]
    chunks, rows = _labelled(docs, size, num, den, id_col, text_col, rest, Scope.of(scope, docs))
    gone = rows.where("keep IS NOT NULL AND keep != row").select("chunk", "row")

    def kept(all_rows: pa.Table, dropped: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        return all_rows.filter(pc.invert(pc.is_in(all_rows["row"], value_set=dropped["row"].combine_chunks()))).select(["content", "rest"])

    found = chunks.select("chunk", "row", "content", "rest").groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(kept, chunks.select("content", "rest").schema)
    return found.select(*[(F.col("rest")[c] if c in rest else F.col("content")).alias(c) for c in docs.columns])
