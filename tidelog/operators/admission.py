"""Requests in the order of their arrival: which fit into what is left, and how they are grouped into micro-batches.

Both go from request to request, each decision resting on all before. Only sizes take part, a row for each request: partitions of the order are summed up
at once, the sums are gone through one after another, and partitions then decide for themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of ``seq`` that number rows within a partition, as monotonically_increasing_id does.
WITHIN = 33
FOLD_SCHEMA = "part long, total long, before array<bigint>, cuts array<bigint>, fill array<bigint>"


def _parts(sizes: DataFrame) -> DataFrame:
    return sizes.where("n > 0").select("seq", F.col("n").cast("long").alias("n"), F.shiftright("seq", WITHIN).alias("part"))


def beyond(sizes: DataFrame, room: int) -> DataFrame:
    """``(seq)`` of the requests of ``sizes(seq long, n)`` that don't fit: first come first served, none in part; one that is refused takes no room.

    Partitions that fit as a whole are told by their sums. The others are read, one after another, as far as their requests are no larger than what is left: each has
    one that is taken, or is passed over by its smallest, so little is read once the room is gone. Requests without entries always fit.
    """
    parts = _parts(sizes)
    sums = sorted(tuple(x) for x in parts.groupBy("part").agg(F.sum("n"), F.min("n")).collect())
    left, whole, taken = max(0, room), [], []
    for part, total, least in sums:
        if total <= left:
            whole.append(part)
            left -= total
        elif least <= left:
            for seq, n in parts.where((F.col("part") == part) & (F.col("n") <= left)).select("seq", "n").orderBy("seq").toLocalIterator():
                if n <= left:
                    taken.append((seq,))
                    left -= n
                if not left:
                    break
    spark = sizes.sparkSession
    rest = parts.join(spark.createDataFrame([(x,) for x in whole], "part long"), "part", "left_anti")
    return rest.join(spark.createDataFrame(taken, "seq long"), "seq", "left_anti").select("seq")


def _starts(before: np.ndarray, first: int, most: int) -> list[int]:
    """Where micro-batches begin, if one does at ``first``; ``before`` has the sums of all sizes before each request, and of all."""
    out, i = [], first
    while i < len(before) - 1:
        out.append(i)
        i = max(i + 1, int(np.searchsorted(before, before[i] + most, side="right")) - 1)
    return out


def _first_cut(before: np.ndarray, fill: int, most: int) -> int:
    """The first request that doesn't fit into a micro-batch that has ``fill`` of ``most`` entries, of as many as there are sums."""
    return 0 if fill > most else int(np.searchsorted(before, most - fill, side="right")) - 1


def _fold(most: int):
    def fold(part: pa.Table) -> pa.Table:
        part = part.sort_by("seq")
        before = np.concatenate([[0], np.cumsum(part["n"].to_numpy())])
        n = len(before) - 1
        # From the end: how many micro-batches begin from a start on, and what the last one has.
        following = np.maximum(np.arange(n) + 1, np.searchsorted(before, before[:-1] + most, side="right") - 1)
        cuts, fill = np.ones(n + 1, np.int64), before[-1] - before
        for i in range(n - 1, -1, -1):
            if following[i] < n:
                cuts[i], fill[i] = cuts[following[i]] + 1, fill[following[i]]
        # Whatever stands open before, the first cut is among the requests that fit into an empty one, or the next.
        near = min(n, int(np.searchsorted(before, most, side="right")))
        return pa.table({"part": part["part"].slice(0, 1), "total": pa.array([int(before[-1])]), "before": pa.array([before[: near + 1].tolist()]), "cuts": pa.array([cuts[:near].tolist()]), "fill": pa.array([fill[:near].tolist()])})

    return fold


def _number(most: int):
    def number(requests: pa.Table, known: pa.Table) -> pa.Table:
        requests = requests.sort_by("seq")
        first, fill = known["number"][0].as_py(), known["fill"][0].as_py()
        before = np.concatenate([[0], np.cumsum(requests["n"].to_numpy())])
        begin = _starts(before, 0 if fill == 0 else _first_cut(before, fill, most), most)
        marks = np.zeros(requests.num_rows, np.int64)
        marks[begin] = 1
        return pa.table({"seq": requests["seq"], "microbatch": pa.array(first + np.cumsum(marks), pa.int64())})

    return number


def microbatches(sizes: DataFrame, most: int) -> DataFrame:
    """``(seq, microbatch)`` of the requests of ``sizes(seq long, n)`` that have entries: whole requests in groups of at most ``most`` entries, numbered from 1.

    Requests go one after another by ``seq``; a group ends where the next doesn't fit, and a request that is larger than ``most`` goes alone. A partition
    works out what becomes of it for any group that stands open before: where the first cut falls decides all that follows, so there are at most ``most`` cases, and
    they alone are gathered.
    """
    if most < 1:
        raise ValueError("a micro-batch must have room for an entry")
    parts = _parts(sizes)
    folds = sorted((tuple(x) for x in parts.groupBy("part").applyInArrow(_fold(most), FOLD_SCHEMA).collect()), key=lambda x: x[0])
    known, number, fill = [], 0, 0
    for part, total, before, cuts, fills in folds:
        known.append((part, number, fill))
        first = 0 if fill == 0 else _first_cut(np.array(before), fill, most)
        number, fill = (number + cuts[first], fills[first]) if first < len(cuts) else (number, fill + total)
    starts = sizes.sparkSession.createDataFrame(known, "part long, number long, fill long")
    return parts.groupBy("part").cogroup(starts.groupBy("part")).applyInArrow(_number(most), "seq long, microbatch long")
