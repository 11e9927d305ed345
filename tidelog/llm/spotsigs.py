"""SpotSigs fingerprints: chains of content words that follow common words.

Every common word of a text (an anchor) starts a chain of the next content words; the chain's hash is a signature, and a text's
fingerprint is the set of its signatures. Furniture of few sentences has few anchors, so fingerprints follow the prose. Similar
fingerprints are found in bands of set length by a pruned Jaccard join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.chunks import Cutter, bucket_count, chunk_bytes, text_bytes
from tidelog.llm.jaccard import document_sets, labelled_rows
from tidelog.llm.storage import Scope
from tidelog.llm.words import Words, mix, sliced

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be been but by can do for from had has have he her his if in is it its not of on one or she that the their there they this to was we were which who will with would you "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "al como con cuando del el ella ellos era es esta este ha hay la las lo los más me muy no nos para pero por porque se si sin sobre son su sus también te tiene una uno y ya"
)
#: Everything ASCII that is neither a letter nor a digit.
SEPARATORS = tuple(b for b in range(128) if not chr(b).isalnum())
#: Rows that are fingerprinted at once; keys that are drawn for each range of ids to find where it ends.
ROWS, DRAWN = 256, 20
#: Ranges that texts are dealt in, at most. A task goes through its range in order, so how long a range is doesn't matter to its memory.
MOST_RANGES = 20_000
LOWEST = -(1 << 63)


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


@lru_cache(2)
def _anchor_hashes(anchors: str) -> np.ndarray:
    words = [w.encode() for w in sorted(set(anchors.split()))]
    return np.sort(Words(*_buffer(words), True, SEPARATORS, 0).hashes)


def signature_sets(texts: pa.Array, chain: int = 2, anchors: str = ANCHORS) -> Iterator[np.ndarray]:
    """The sorted distinct signatures of each text, as 64-bit numbers.

    A text without a whole chain has the hashes of its words instead; one without words, but not empty, the hash of its bytes; an empty
    one has none.
    """
    known = _anchor_hashes(anchors)
    for _, _, data, offsets in sliced(texts):
        words = Words(data, offsets, True, SEPARATORS, 0)
        anchor = known[np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)] == words.hashes
        content, spots = np.flatnonzero(~anchor), np.flatnonzero(anchor)
        end = np.repeat(words.at[1:], words.counts())[spots]
        following = np.searchsorted(content, spots)
        last = following + chain - 1
        whole = last < len(content)
        whole[whole] = content[last[whole]] < end[whole]
        spots, following = spots[whole], following[whole]
        h = np.zeros(len(spots), np.uint64)
        for k in range(chain - 1, -1, -1):
            h = mix(h + words.hashes[content[following + k]])
        h = mix(h + words.hashes[spots])
        at = np.searchsorted(spots, words.at)
        for k in range(len(offsets) - 1):
            if at[k + 1] > at[k]:
                yield np.unique(h[at[k] : at[k + 1]])
            elif words.at[k + 1] > words.at[k]:
                yield np.unique(words.hashes[words.at[k] : words.at[k + 1]])
            else:
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                yield np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest() if raw else b"", np.uint64)


def written(signatures: np.ndarray) -> str:
    """A fingerprint as text: sixteen hex digits for each signature, in order."""
    return signatures.astype(">u8").tobytes().hex()


def _digest(signatures: np.ndarray) -> bytes:
    return hashlib.blake2b(signatures.astype("<u8").tobytes(), digest_size=16).digest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two fingerprints; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, chain: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)``, one row for each row of ``docs``; null is as empty, with an empty fingerprint. Other columns are left out."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fingerprint": pa.array([written(s) for s in signature_sets(batch.column("text"), chain)], pa.string())})

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(found, schema)


def _classes(docs: DataFrame, chain: int, num: int, den: int, id_col: str, text_col: str, scope: Scope) -> DataFrame:
    """``(id, digest, n_items, label)`` for each row of ``docs``; digest and label are null where no other fingerprint can be similar."""

    total = text_bytes(docs, text_col)
    limit = chunk_bytes(total)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(limit)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                prints = [s.tobytes() for s in signature_sets(batch.column("text"), chain)]
                chunk = cutter.cut(batch.column("row").to_numpy(), np.array([len(x) for x in prints], np.int64))
                yield pa.record_batch({"chunk": pa.array(chunk, pa.int64()), "row": batch.column("row"), "id": batch.column("id"), "content": pa.array(prints, pa.binary())})

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Fingerprints are cut where they are made; texts aren't stored.
    chunks = scope.bucketed(numbered.mapInArrow(found, "chunk long, row long, id long, content binary"), bucket_count(total), "chunk", "prints")

    def sets_of(contents: pa.Array) -> Iterator[np.ndarray]:
        for x in contents:
            yield np.frombuffer(x.as_buffer(), np.uint64)

    rows = scope.stored(document_sets(chunks, sets_of, total, num, den), "prints", free=True)
    scope.drop(chunks)
    return labelled_rows(rows, num, den, scope, banded=True)


def similar(docs: DataFrame, chain: int = 2, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text", scope: Scope | None = None) -> DataFrame:
    """``(doc_id, n_signatures, component_id)`` for each row of ``docs``: classes of fingerprints linked by den * intersection >= num * union.

    Equal fingerprints are one class. Signatures are ordered from rare to common over all documents, and only sets in the same or the next band of lengths meet. Empty
    fingerprints link with nothing; the class of a row without links is its own id, that of others the smallest id.
    """
    rows = _classes(docs, chain, num, den, id_col, text_col, Scope.of(scope, docs))
    return rows.select(F.col("id").alias("doc_id"), F.col("n_items").alias("n_signatures"), F.coalesce("label", "id").alias("component_id"))


def _cuts(rows: DataFrame, ranges: int) -> np.ndarray:
    """Keys at which ranges begin, from keys drawn by a hash: ``DRAWN`` for each range, however many rows there are. Where they lie decides how even ranges are, and nothing else."""
    count = rows.count()
    share = min(1.0, ranges * DRAWN / max(count, 1))
    drawn = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("key").toPandas()["key"].to_numpy(np.int64)
    return np.unique(np.quantile(np.sort(drawn), np.arange(1, ranges) / ranges, method="nearest")) if len(drawn) else drawn


def probe_edits(docs: DataFrame, chain: int = 2, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text", scope: Scope | None = None) -> DataFrame:
    """Fingerprints of texts and of edited texts, whose last quarter is replaced by the start of the next document, how alike they are, and classes.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id`` for each row. The next document is that of the
    next id, for the last the first; a null id is below all others, and rows that share an id follow each other by text. A null text is empty. A
    document alone is its own next. ``component_id`` is that of :func:`similar`.

    Texts are dealt once, in ranges of ids; only the first row of a range is also sent to the range before. Classes come first, and are dealt with them.
    """
    scope = Scope.of(scope, docs)
    spark = docs.sparkSession
    classes = _classes(docs, chain, num, den, id_col, text_col, scope)
    linked = classes.where("digest IS NOT NULL AND NOT (label <=> id)").select(F.col("id").alias("doc_id"), "digest", F.col("label").alias("component"))
    linked = scope.stored(linked, "linked", free=True)

    key = F.coalesce("doc_id", F.lit(LOWEST)).alias("key")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).select("doc_id", "text", key)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(24, -(-total // (2 * chunk_bytes(total)))))
    bounds = _cuts(rows, ranges)

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    # One row for each range.
    firsts = rows.groupBy(range_of("key").alias("range")).agg(F.min("key").alias("key")).orderBy("key").collect()
    before = [(first["key"], firsts[i - 1]["range"]) for i, first in enumerate(firsts)]
    heads = spark.createDataFrame(before, "key long, range int")
    none = {"digest": F.lit(None).cast("binary"), "component": F.lit(None).cast("long")}
    tails = rows.join(F.broadcast(heads), "key").select(*rows.columns, F.lit(2).alias("kind"), "range").withColumns(none)
    dealt = rows.select(*rows.columns, F.lit(1).alias("kind"), range_of("key").alias("range")).withColumns(none)
    known = linked.select("doc_id", F.lit(None).cast("string").alias("text"), key, F.lit(0).alias("kind"), "digest", "component")
    known = known.withColumn("range", range_of("key"))
    # In a range, by key: the classes of a key's rows, then the rows; the tail is last.
    order = ("range", F.col("kind") == 2, "key", "kind", "text")
    together = dealt.unionByName(tails).unionByName(known).repartitionById(ranges, "range").sortWithinPartitions(*order)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a row that waits for the next
        at_key, components = None, {}

        def out(pairs: list[tuple]) -> pa.RecordBatch:
            edited = []
            for (_, text, *_), (_, following, *_) in pairs:
                cut = len(text) // 4
                edited.append((text[: len(text) - cut] + following[:cut]) if cut else text)
            prints = list(signature_sets(pa.array(edited, pa.large_string()), chain))
            return pa.record_batch(
                {
                    "doc_id": pa.array([a[0] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    "fingerprint": pa.array([written(a[2]) for a, _ in pairs], pa.string()),
                    "edited_fingerprint": pa.array([written(p) for p in prints], pa.string()),
                    "near_edited": pa.array([likeness(a[2], p) for (a, _), p in zip(pairs, prints)], pa.float64()),
                    "near_next": pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
                    "component_id": pa.array([a[3] for a, _ in pairs], pa.int64()),
                }
            )

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts, pairs = batch.column("text"), []
                columns = (batch.column(c).to_pylist() for c in ("doc_id", "key", "range", "kind", "digest", "component"))
                for doc_id, key, number, kind, digest, component, text, signatures in zip(*columns, texts.to_pylist(), signature_sets(texts, chain)):
                    if (number, key) != at_key:
                        at_key, components = (number, key), {}
                    if kind == 0:
                        components[digest] = component
                        continue
                    row = (doc_id, text, signatures, components.get(_digest(signatures), doc_id) if components else doc_id)
                    if held and held[0] == number:
                        pairs.append((held[1], row))
                    held = None if kind == 2 else (number, row)
                if pairs:
                    yield out(pairs)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"
    return together.select("doc_id", "text", "key", "range", "kind", "digest", "component").mapInArrow(probed, schema)
