"""Ids and running sums in an order: over sorted ranges, or as rows were stored."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.names import unused
from tidelog.scratch import new_path


def quoted(columns: list[str] | tuple[str, ...]) -> list[str]:
    return [f"`{c}`" for c in columns]


def _sorted(rows: DataFrame, order: tuple, path: str | None) -> tuple[DataFrame, str, str]:
    """``rows`` in ``order`` from the shared folder, and their columns of partition and place in it; all passes see the same."""
    part, place = unused(rows.columns, "part", "place")
    path, at = path or new_path(rows.sparkSession, "ordered"), F.monotonically_increasing_id()
    rows.orderBy(*order).withColumns({part: F.shiftright(at, 33), place: at.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    return rows.sparkSession.read.parquet(path), part, place


def _offsets(spark, parts: list, part: str, names: dict[str, str]) -> DataFrame:
    """What comes before each partition. One row for each partition of the sort is gathered: as many as spark.sql.shuffle.partitions, at most."""
    before, rows = [0.0 if kind == "double" else 0 for kind in names.values()], []
    for number, *sums in sorted(parts):
        rows.append((number, *before))
        before = [a + (b or 0) for a, b in zip(before, sums)]
    return F.broadcast(spark.createDataFrame(rows, ", ".join(f"`{x}` {kind}" for x, kind in {part: "long", **names}.items())))


def numbered(rows: DataFrame, order: tuple[str, ...], name: str = "id", path: str | None = None) -> tuple[DataFrame, int]:
    """``rows`` with a dense long column ``name``, counted from 1 in ``order``, and how many there are. The sorted rows are written to ``path``."""
    staged, part, place = _sorted(rows, order, path)
    parts = [tuple(x) for x in staged.groupBy(part).count().collect()]
    (before,) = unused(staged.columns, "before")
    found = staged.join(_offsets(rows.sparkSession, parts, part, {before: "long"}), part)
    number = (F.col(before) + F.col(place) + 1).alias(name)
    return found.select(number, *quoted([c for c in rows.columns if c != name])), sum(n for _, n in parts)


def numbered_as_stored(rows: DataFrame, name: str = "id") -> tuple[DataFrame, int]:
    """``rows``, read from Parquet files that one job wrote, with a dense long column ``name``, counted from 1 in the order in which that job had them, and how many there are.

    A file knows the place of each of its rows, so there is nothing to sort or to send: a count for each file is gathered, from footers alone.
    """
    file, place, before = unused(rows.columns, "file", "place", "before")
    placed = rows.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(place))
    task = lambda f: tuple(int(x) for x in re.search(r"part-(\d+)-.*[.-]c(\d+)", f).groups())
    counts = sorted((tuple(x) for x in placed.groupBy(file).count().collect()), key=lambda x: task(x[0]))
    at, offsets = 0, []
    for f, n in counts:
        offsets.append((f, at))
        at += n
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"`{file}` string, `{before}` long"))
    number = (F.col(before) + F.col(place) + 1).alias(name)
    return placed.join(known, file).select(number, *quoted([c for c in rows.columns if c != name])), at


def assign_ids(rows: DataFrame, order: tuple[str, ...], base: int = 0) -> DataFrame:
    """``rows`` with a dense long ``id`` from ``base + 1`` on, rising in ``order``; only a count for each partition is gathered."""
    found, _ = numbered(rows, order)
    return found.withColumn("id", F.col("id") + F.lit(base))


def running_sums(rows: DataFrame, order: tuple, sums: dict[str, str], path: str | None = None) -> DataFrame:
    """``rows`` with a column for each of ``sums``: the sum of the named column of longs or doubles over all rows before it in ``order``, 0 for the first.

    Sums run within the sorted partitions, each for itself; a sum for each partition is gathered and added. Nulls count as 0.
    """
    staged, part, place = _sorted(rows, order, path)
    before = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    parts = [tuple(x) for x in staged.groupBy(part).agg(*[F.sum(c) for c in sums.values()]).collect()]
    kinds = [rows.schema[c].dataType.simpleString() for c in sums.values()]
    names = dict(zip(unused([*staged.columns, *sums], *[f"before_{x}" for x in sums]), ["double" if k in ("double", "float") else "long" for k in kinds]))
    found = staged.withColumns({x: F.coalesce(F.sum(c).over(before), F.lit(0)) for x, c in sums.items()})
    found = found.join(_offsets(rows.sparkSession, parts, part, names), part)
    return found.select(*quoted([c for c in rows.columns if c not in sums]), *[(F.col(x) + F.col(b)).alias(x) for x, b in zip(sums, names)])
