"""How far the sources of a language are from each other and from the language, by their terms: exact, over all pairs of sources.

Counts of terms by source are a sparse matrix for each language. It is cut into strips of terms and tiles of sources, of bounded size, and each cut
becomes a k-squared quadtree: bits that say, level by level, which quadrants hold any count, and the counts of the last level. Pairs of
sources walk a tree together. Where both have an empty quadrant, its terms cost the same each and are priced by their number; the walk goes down only
where one of the two has something, to the single counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.storage import Scope
from tidelog.llm.words import SLICE_BYTES, Words, buffers, sliced

#: Everything ASCII that isn't a letter.
SEPARATORS = tuple(b for b in range(128) if not chr(b).isalpha())
#: Terms of a strip and sources of a tile, about; pairs of quadrants, and terms whose letters are gathered, that are looked at in one go.
STRIP, TILE, AT_ONCE = 4096, 96, 1 << 16
#: Counts by text that are added up in one go, and bytes of texts whose counts are: they bound a worker's memory, not a text's length.
FOLDED, RUN_BYTES = 1 << 18, 1 << 24
SCALE = 1_000_000_000
COUNTS_SCHEMA = "lang string, source string, term string, n long, docs long"
SUMS_SCHEMA = "lang string, a string, b string, value long"


def _pieces(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(from, to, bytes, offsets, where they begin) of runs of texts of about ``limit`` bytes; a longer text comes in pieces that end at separators."""
    apart = np.zeros(256, bool)
    apart[list(SEPARATORS)] = True
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        begin, end = int(offsets[i]), int(offsets[j])
        if j > i + 1 or end - begin <= limit:
            yield i, j, data[begin:end], offsets[i : j + 1] - begin, begin
        else:
            while begin < end:
                cut, step = min(end, begin + limit), limit
                while cut < end and not apart[data[cut]]:  # up to the next separator
                    ahead = np.flatnonzero(apart[data[cut : min(end, cut + step)]])
                    cut, step = (cut + int(ahead[0]), step) if len(ahead) else (min(end, cut + step), 2 * step)
                yield i, j, data[begin:cut], np.array([0, cut - begin]), begin
                begin = cut
        i = j


def _summed(keys: tuple[np.ndarray, ...], sums: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first row of each different key, by key, and the sums over its rows."""
    order = np.lexsort(keys[::-1])
    first = np.zeros(len(order), bool)
    for k in keys:
        first[1:] |= np.diff(k[order]) != 0
    first[:1] = True
    at = np.flatnonzero(first)
    return order[at], [np.add.reduceat(x[order], at) if len(at) else x for x in sums]


def _texts(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The lower-cased texts at places of ``data``."""
    ends = np.concatenate([[0], np.cumsum(length)])
    letters = np.empty(ends[-1], np.uint8)
    for k in range(0, len(start), AT_ONCE):
        some = slice(k, k + AT_ONCE)
        own = ends[k : k + AT_ONCE + 1]
        letters[own[0] : own[-1]] = data[np.arange(own[0], own[-1]) + np.repeat(start[some] - own[:-1], length[some])]
    letters[(letters >= 65) & (letters <= 90)] += 32
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)]).cast(pa.string())


def count_terms(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(group, occurrences, documents, term) of the terms of some texts that belong to groups. Terms are told apart by hashes of 64 bits."""
    data, offsets = buffers(texts)
    parts: list[tuple[np.ndarray, ...]] = []
    whole: list[tuple[np.ndarray, ...]] = []

    def close() -> None:
        """Add up by group what was counted by text; no text of it goes on."""
        h, doc, n, start, length = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        first, (n,) = _summed((h, doc), (n,))  # pieces of one text
        h, group, start, length = h[first], groups[doc[first]], start[first], length[first]
        first, (n, docs) = _summed((h, group), (n, np.ones(len(h), np.int64)))
        whole.append((h[first], group[first], n, docs, start[first], length[first]))

    last = -1
    for i, j, own, at, begin in _pieces(data, offsets, SLICE_BYTES):
        if i != last and sum(len(x[0]) for x in parts) >= FOLDED:
            close()
        last = i
        words = Words(own, at, True, SEPARATORS, 0)
        if not len(words.hashes):
            continue
        doc = np.repeat(np.arange(i, j), words.counts())
        length = words.ends - words.starts
        by_doc, (n,) = _summed((words.hashes, doc), (np.ones(len(doc), np.int64),))
        parts.append((words.hashes[by_doc], doc[by_doc], n, words.starts[by_doc] + begin, length[by_doc]))
    if parts:
        close()
    if not whole:
        none = np.zeros(0, np.int64)
        return none, none, none, pa.array([], pa.string())
    h, group, n, docs, start, length = (np.concatenate(x) for x in zip(*whole))
    whole.clear()
    first, (n, docs) = _summed((h, group), (n, docs))
    return group[first], n, docs, _texts(data, start[first], length[first])


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of a term, and documents that have it. A row without a term is there for each lang and source."""

    def rows(names: list[tuple[str, str]], groups: np.ndarray, n: np.ndarray, docs: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
        langs, sources = (pa.array([x[k] for x in names], pa.string()).take(pa.array(groups)) for k in (0, 1))
        return pa.record_batch({"lang": langs, "source": sources, "term": terms, "n": pa.array(n), "docs": pa.array(docs)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            names = sorted(set(both))
            number = {x: k for k, x in enumerate(names)}
            of = np.array([number[x] for x in both])
            yield rows(names, np.arange(len(names)), *[np.zeros(len(names), np.int64)] * 2, pa.nulls(len(names), pa.string()))
            for i, j, _, _ in sliced(batch.column("text"), RUN_BYTES):
                yield rows(names, *count_terms(batch.column("text").slice(i, j - i), of[i:j]))

    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    given = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    return given.mapInArrow(counted, COUNTS_SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly, by division digit by digit: totals may be up to 9 * 10**17."""
    whole = np.maximum(total + 2 * kept, 1)
    out, rest = np.divmod(n + 2, whole)
    for _ in range(9):
        digit, rest = np.divmod(rest * 10, whole)
        out = out * 10 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class QuadTree:
    """A matrix of counts as a k-squared tree with k = 2: the bits of all quadrants of quadrants that hold anything, and the counts below."""

    def __init__(self, row: np.ndarray, column: np.ndarray, counts: np.ndarray, rows: int, columns: int):
        self.rows, self.columns = rows, columns
        self.levels = max(1, int(max(rows, columns) - 1).bit_length())
        code = np.zeros(len(row), np.int64)
        for bit in range(self.levels):
            code |= (((row >> bit) & 1) << (2 * bit + 1)) | (((column >> bit) & 1) << (2 * bit))
        order = np.argsort(code)
        self.cell_row, self.counts, code = row[order], counts[order], code[order]
        self.bits: list[np.ndarray] = []
        above = np.zeros(min(1, len(code)), np.int64)
        for level in range(1, self.levels + 1):
            nodes = np.unique(code >> (2 * (self.levels - level)))
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            above = nodes
        # A set bit's rank is the number of its quadrant on the next level; of the last, that of its count.
        self.rank = [np.cumsum(b) - 1 for b in self.bits]

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The quadrants of nodes of a level, -1 for those that hold nothing."""
        out = np.full(len(node), -1)
        some = np.flatnonzero(node >= 0)
        at = 4 * node[some] + quadrant[some]
        held = self.bits[level][at]
        out[some[held]] = self.rank[level][at[held]]
        return out

    def pair_sums(self, cell_price: np.ndarray, zero_price: np.ndarray, border: int) -> np.ndarray:
        """The sum over columns of the distance of each pair of rows: those before ``border`` with those from there on, or, if it is 0, all.

        A task walks with all pairs at once, level by level, ``AT_ONCE`` pairs of quadrants at a time and what is deeper first.
        """
        sums = np.zeros((self.rows, self.rows), np.int64)
        zeros = np.zeros((self.rows + 1, self.rows + 1), np.int64)
        root = np.array([0 if len(self.counts) else -1])
        none = np.zeros(1, np.int64)
        waiting = [(0, root, root, none, none, none)]
        step = np.arange(8)
        di, dj, dk = step >> 2, (step >> 1) & 1, step & 1
        while waiting:
            level, u, v, i, j, k = waiting.pop()
            if len(u) > AT_ONCE:
                waiting += [(level, *(x[a:b] for x in (u, v, i, j, k))) for a, b in ((0, len(u) // 2), (len(u) // 2, len(u)))]
                continue
            width = 1 << (self.levels - level)
            # Both quadrants are empty: so many columns at the price of two zeros, for all pairs of their rows.
            empty = (u < 0) & (v < 0)
            if empty.any():
                n = np.clip(self.columns - k[empty] * width, 0, width)
                top, left = np.minimum(i[empty] * width, self.rows), np.minimum(j[empty] * width, self.rows)
                bottom, right = np.minimum(top + width, self.rows), np.minimum(left + width, self.rows)
                for x, y, sign in ((top, left, 1), (bottom, left, -1), (top, right, -1), (bottom, right, 1)):
                    np.add.at(zeros, (x, y), sign * n)
                u, v, i, j, k = (x[~empty] for x in (u, v, i, j, k))
            if level == self.levels:
                p = np.where(u >= 0, cell_price[u], zero_price[i])
                q = np.where(v >= 0, cell_price[v], zero_price[j])
                np.add.at(sums, (i, j), distance(p, q))
                continue
            if not len(u):
                continue
            all_ = lambda x: np.repeat(x, 8)
            each = lambda x: np.tile(x, len(u))
            i2, j2, k2 = 2 * all_(i) + each(di), 2 * all_(j) + each(dj), 2 * all_(k) + each(dk)
            half = width // 2
            needed = (i2 <= j2) & (j2 * half < self.rows) & (k2 * half < self.columns)
            if border:
                needed &= (i2 * half < border) & ((j2 + 1) * half > border)
            if half == 1:
                needed &= i2 < j2
            at = np.flatnonzero(needed)
            u2 = self.child(level, np.repeat(u, 8)[at], (2 * each(di) + each(dk))[at])
            v2 = self.child(level, np.repeat(v, 8)[at], (2 * each(dj) + each(dk))[at])
            waiting.append((level + 1, u2, v2, i2[at], j2[at], k2[at]))
        zeros = zeros.cumsum(0).cumsum(1)[: self.rows, : self.rows]
        return sums + zeros * distance(zero_price[:, None], zero_price[None, :])


def _tile_sums(tile: pa.Table) -> pa.Table:
    """The distances of the sources of one or two tiles over the terms of a strip."""
    groups = tile.filter(pc.is_null(tile["term"])).sort_by([("own", "ascending"), ("source", "ascending")])
    cells = tile.filter(pc.is_valid(tile["term"]))
    names = groups["source"].to_pylist()
    own = groups["own"].to_numpy()
    if tile["low"][0] != tile["high"][0] and own[0] == own[-1]:  # the other tile has no sources
        return pa.table({c: pa.array([], t) for c, t in (("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()))})
    width, kept = (int(groups[c][0].as_py()) for c in ("n", "kept"))
    row = {s: r for r, s in enumerate(names)}
    rows = np.array([row[s] for s in cells["source"].to_pylist()], np.int64)
    _, column = np.unique(cells["term"].to_numpy().astype(object), return_inverse=True)
    # Terms of many sources first, so that what is empty is in one piece.
    order = np.argsort(-np.bincount(column, minlength=1), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = cells["n"].to_numpy().astype(np.int64)
    tree = QuadTree(rows, place[column], n, len(names), width)
    total = groups["total"].to_numpy().astype(np.int64)
    border = int(np.searchsorted(own, own[-1])) if own[0] != own[-1] else 0
    sums = tree.pair_sums(price(tree.counts, total[tree.cell_row], kept), price(np.zeros(len(names), np.int64), total, kept), border)
    a, b = np.triu_indices(len(names), 1)
    if border:
        a, b = (x[(a < border) & (b >= border)] for x in (a, b))
    names = np.array(names, object)
    return pa.table({"lang": pa.array([tile["lang"][0].as_py()] * len(a), pa.string()), "a": pa.array(names[a], pa.string()), "b": pa.array(names[b], pa.string()), "value": pa.array(sums[a, b], pa.int64())})


def _price(n: str, total: str) -> Column:
    """:func:`price` of columns, with ``kept`` terms."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * kept AS DECIMAL(20,0))")


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """With a ``rank`` in each lang and source, by falling value and then item, up to ``most``."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most) if most else ranked


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", scope: Scope | None = None) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a language is from every other, and its terms that set it apart most.

    Terms are runs of letters A-Z, lower-cased, and of anything beyond ASCII. A language keeps those that ``least_docs`` of its documents have. A source,
    and the language itself, gives a kept term the share ``p = 1 + floor(10**9 * (n + 2) / (N + 2 * V))`` of its N occurrences of V kept terms; two shares are
    ``floor((p - q)**2 / (p + q))`` apart. ``pair`` rows have the sum over all kept terms for each other source (0 where none is kept), ``term`` rows the
    ``top`` terms that a source has and gives a larger share than its language. Ranks count from 1 by falling value, then by item.

    Nulls in any of the three columns are empty texts; a lang and source without terms is there too. Repeated rows count each. No rows give no rows;
    other columns are left out.
    """
    scope, key = Scope.of(scope, docs), ["lang", "source"]
    counts = scope.stored(term_counts(docs, lang_col, source_col, text_col), "counts", free=True)
    held = counts.where("term IS NOT NULL")
    terms = held.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs")
    terms = scope.stored(terms, "terms")
    cells = scope.stored(held.select(*key, "term", "n").join(terms, ["lang", "term"]), "cells", free=True)
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    names = counts.where("term IS NULL").select(*key)
    sizes = names.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left")
    sizes = sizes.select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "lang_total")], F.ceil(F.col("sources") / TILE).alias("tiles"))
    sizes = scope.stored(sizes.withColumn("strips", F.greatest(F.ceil(F.col("kept") / STRIP), F.lit(1))), "sizes")
    groups = names.join(cells.groupBy(*key).agg(F.sum("n").alias("total")), key, "left").join(sizes, "lang")
    groups = scope.stored(groups.withColumns({"total": F.coalesce("total", F.lit(0)), "own": F.pmod(F.xxhash64("source"), "tiles")}), "groups")
    scope.drop(counts)

    strip = F.pmod(F.xxhash64("term"), "strips").alias("strip")
    widths = terms.join(sizes, "lang").groupBy("lang", strip).agg(F.count("*").alias("n"))
    shown = [*key, "strip", "term", "n", "total", "kept", "own", "tiles"]
    marks = groups.withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).join(widths, ["lang", "strip"], "left")
    marks = marks.withColumns({"n": F.coalesce("n", F.lit(0)), "term": F.lit(None).cast("string")})
    tiled = cells.join(groups, key).withColumn("strip", strip).select(*shown).union(marks.select(*shown))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select(*shown[:-1], F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    sums = tiled.groupBy("lang", "strip", "low", "high").applyInArrow(_tile_sums, SUMS_SCHEMA).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = _ranked(sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value"))

    shares = cells.join(groups.select(*key, "total", "kept", "lang_total"), key).select(*key, F.col("term").alias("item"), _price("n", "total").alias("p"), _price("lang_n", "lang_total").alias("q"))
    apart = _ranked(shares.where("p > q").select(*key, "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value")), top)
    show = lambda rows, part: rows.select(*key, F.lit(part).alias("part"), "item", "value", "rank")
    return show(pairs, "pair").union(show(apart, "term"))
