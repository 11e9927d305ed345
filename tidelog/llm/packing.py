"""Best-fit packing of documents into bins of several permitted lengths.

Documents are cut into pieces no longer than the longest permitted length. Pieces are dealt by a hash into shards of
bounded size, and each shard is packed by itself: longest piece first, into the open bin that it fills best; if none has
room, a new bin is opened. The lengths of new bins are those with which the whole shard costs least. At the end each
bin shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.storage import Scope

#: Pieces in a shard, about; a shard is packed in one task. Nothing else says how pieces are dealt, so a corpus is packed alike on any cluster.
SHARD_PIECES = 8192
SCHEMA = "doc_id long, copy long, piece int, start long, length long, bin_id string, bin_offset long, bin_used long, bin_capacity long"


def quadratic_cost(length: int, per_pair: float = 1 / 8192) -> float:
    """Cost of one sequence: linear work for each token and a small term for each pair of tokens."""
    return length + per_pair * length * length


def _packed(lengths: np.ndarray, permitted: Sequence[int], opens: dict[int, int]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """:func:`best_fit` where a piece for which no bin has room opens one of ``opens[c]``; ``c`` is the smallest permitted length that holds it."""
    open_by_room: dict[int, list[int]] = {}
    rooms = 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room = opens[next(c for c in permitted if c >= n)]
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left = room - n
        if left:
            if not open_by_room.setdefault(left, []):
                rooms |= 1 << left
            open_by_room[left].append(b)
    return bins, offsets, [next(c for c in permitted if c >= u) for u in used], used


def best_fit(lengths: np.ndarray, permitted: Sequence[int], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Pack ``lengths``, given in falling order: (bin, offset) of each piece, and capacity and use of each bin.

    Open bins are kept by the room they have left; the rooms in use are the bits of one number, so the tightest fit is its
    lowest bit at or above the length. Pieces are of a class by the smallest permitted length that holds them. Which length a class opens is
    found by packing: class by class, longest first, and over again until none changes, the length is taken with which all bins cost least.
    """
    permitted = sorted(permitted)
    opens = {c: c for c in permitted}
    best = _packed(lengths, permitted, opens)
    least = sum(map(cost, best[2]))
    present = {next(c for c in permitted if c >= n) for n in set(lengths.tolist())}
    changed = True
    while changed:
        changed = False
        for own in sorted(present, reverse=True):
            for other in permitted:
                if other < own or other == opens[own]:
                    continue
                found = _packed(lengths, permitted, opens | {own: other})
                total = sum(map(cost, found[2]))
                if total < least:
                    best, least, opens, changed = found, total, opens | {own: other}, True
    return best


def pack(sizes: DataFrame, permitted: Sequence[int] = (512, 1024, 2048, 4096), cost: Callable[[int], float] = quadratic_cost, seed: int = 7, scope: Scope | None = None) -> DataFrame:
    """Packed pieces of ``sizes(doc_id long, size long)``: one row per piece, with its bin.

    ``piece`` counts a document's pieces from 0, ``start`` is the piece's first token, ``bin_offset`` its place in the bin. Rows that
    share a doc_id are told apart by ``copy``, counted from 0. Null or negative sizes count as 0 and documents of size 0 have no piece. A null
    doc_id is kept as null. No rows give no rows.
    """
    permitted = sorted(int(x) for x in permitted)
    longest = permitted[-1]
    # Identical rows are counted, so that every copy has a number without gathering the copies.
    each = Scope.of(scope, sizes).stored(sizes.select("doc_id", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("size")).where("size > 0").groupBy("doc_id", "size").count(), "sizes")
    before = Window.partitionBy("doc_id").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        each.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select("doc_id", "size", F.explode(F.expr("sequence(first, first + count - 1)")).alias("copy"))
        .select("doc_id", "copy", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {longest})")).alias("piece"))
        .select("doc_id", "copy", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("size") - F.col("piece") * longest).alias("length"))
    )
    rows = each.select(F.sum(F.col("count") * (F.expr(f"(size - 1) div {longest}") + 1))).first()[0] or 0
    shards = max(1, -(-rows // SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(seed)), F.lit(shards)))

    def pack_shard(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        bins, offsets, capacity, used = best_fit(shard["length"].to_numpy(), permitted, cost)
        number = shard["shard"][0].as_py()
        return pa.table(
            {
                **{c: shard[c] for c in ("doc_id", "copy", "piece", "start", "length")},
                "bin_id": [f"{number}-{b}" for b in bins.tolist()],
                "bin_offset": offsets,
                "bin_used": np.array(used)[bins],
                "bin_capacity": np.array(capacity)[bins],
            }
        )

    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(pack_shard, SCHEMA)
