"""Approximate nearest neighbours by cosine: a graph built by NN-descent, searched greedily.

Different directions are numbered and kept in blocks of consecutive numbers, one row with arrays for each block. Each node begins with the nearest
of a few that are numbered near it. NN-descent rounds, at every size, are joins by block: every edge is sent to its end, each node pairs the
neighbours of both directions and a few nodes drawn at random, the vectors of these are fetched once for
a block, and pairs that come nearer than what their ends have are sent there. Rounds end when few edges change.

Vectors are sent in single precision and measured in double, so that near copies are told apart.

A search keeps, for each query, the ``width`` nearest nodes seen. In each round, nodes not yet expanded are looked up in the graph by block, their
neighbours are scored where their vectors are, and what is near enough goes back to the query, until no query has a node to expand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.storage import Scope
from tidelog.llm.words import mix
from tidelog.operators.ids import numbered

#: Nodes in a block at 64 dimensions or fewer, nodes among which each finds its first neighbours, and random nodes that it tries in a round.
BLOCK, FIRST, DRAWN = 2048, 256, 4
GRAPH = "block long, vecs binary, nbr binary, sim binary, fresh binary"
IDX, F32, F64 = np.int64, np.float32, np.float64
#: How far a measured nearness may be from the exact one.
ROUNDING = 1e-6


@dataclass(frozen=True)
class Index:
    """``graph`` by block, ``members(vec_id, node)`` of all vectors that take part, their number of nodes, and the dimension."""

    graph: DataFrame
    members: DataFrame
    nodes: int
    dim: int


def _arrow(**columns) -> pa.Table:
    kinds = {"block": pa.int64(), "src": pa.int64(), "kind": pa.int32(), "query": pa.int64()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in columns.items()})


def _by(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arrays by key, in order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for i, j in zip(at, at[1:]):
        if j > i:
            yield int(key[i]), [a[order[i:j]] for a in arrays]


def block_size(dim: int) -> int:
    """Nodes of a block: fewer where vectors are long, so that what a block fetches in a round takes as much memory in any dimension."""
    return max(64, min(BLOCK, BLOCK * 64 // max(dim, 1)))


def _cut(dim: int, order_by: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arrays by the block of ``order_by``."""
    return _by(order_by // block_size(dim), *arrays)


def _join(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table[column].to_pylist())])


def unit(raw: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision; scaled first, so that squares neither overflow nor vanish."""
    raw = raw.astype(F64)
    if len(raw):
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        raw /= np.linalg.norm(raw, axis=1, keepdims=True)
    return raw


def nearest_k(dst: np.ndarray, src: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each ``dst`` its ``k`` nearest different ``src``, nearest first; of equally near ones others for each ``dst``. The first of repeated pairs counts."""
    order = np.lexsort((src, dst))
    first = np.ones(len(dst), bool)
    first[1:] = (np.diff(dst[order]) != 0) | (np.diff(src[order]) != 0)
    order = order[first]
    dst, src, sim = dst[order], src[order], sim[order]
    tie = mix(dst.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ src.astype(np.uint64))
    order = np.lexsort((tie, -sim, dst))
    dst, src, sim = dst[order], src[order], sim[order]
    start = np.flatnonzero(np.diff(dst, prepend=-1) != 0)
    rank = np.arange(len(dst)) - np.repeat(start, np.diff(start, append=len(dst)))
    keep = rank < k
    return dst[keep], src[keep], sim[keep]


def _first_of_each(group: np.ndarray, m: int, limit: int, priority: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, rank) of at most ``limit`` rows of each group below ``m``, by priority."""
    order = np.lexsort((priority, group))
    at = np.searchsorted(group[order], np.arange(m))
    rank = np.arange(len(order)) - at[group[order]] if len(order) else order
    keep = rank < limit
    return order[keep], rank[keep]


class _Graph:
    """The arrays of one block; ``nbr`` is -1 where there are fewer than k neighbours."""

    def __init__(self, table: pa.Table, dim: int, k: int):
        row = table.slice(0, 1).to_pylist()[0]
        self.block = row["block"]
        self.vecs = np.frombuffer(row["vecs"], F32).reshape(-1, dim)
        self.start, self.m = self.block * block_size(dim), len(self.vecs)
        self.nbr = np.frombuffer(row["nbr"], IDX).reshape(self.m, k)
        self.sim = np.frombuffer(row["sim"], F64).reshape(self.m, k)
        self.fresh = np.frombuffer(row["fresh"], np.uint8).reshape(self.m, k).astype(bool)

    def sampled(self, sample: int, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, neighbour, fresh) of the edges that take part in a round: at most ``sample`` fresh and old ones for each node."""
        priority = np.random.default_rng((round_, self.block)).random(self.nbr.shape)
        rows, places = np.nonzero(self.nbr >= 0)
        fresh = self.fresh[rows, places]
        keep = []
        for kind in (True, False):
            own = np.flatnonzero(fresh == kind)
            keep.append(own[_first_of_each(rows[own], self.m, sample, priority[rows[own], places[own]])[0]])
        at = np.concatenate(keep)
        return rows[at], places[at], self.nbr[rows[at], places[at]], fresh[at]


    def tried(self, sample: int, round_: int, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, neighbour, fresh) of the sampled edges and of nodes drawn at random, which count as fresh."""
        rows, _, nbr, fresh = self.sampled(sample, round_)
        far = np.random.default_rng((round_, self.block, 2)).integers(0, nodes, (self.m, DRAWN))
        more, place = np.nonzero(far != np.arange(self.m)[:, None] + self.start)
        return np.concatenate([rows, more]), np.concatenate([nbr, far[more, place]]), np.concatenate([fresh, np.ones(len(more), bool)])


def _grouped(df: DataFrame):
    return df.groupBy("block")


def number_vectors(vectors: DataFrame, id_col: str, vector_col: str, scope: Scope) -> tuple[DataFrame, int, int]:
    """``(vec_id, vector, node)`` of all vectors that take part, those of equal direction with one node; how many nodes, and the dimension.

    Null and zero vectors, and those with null or non-finite components, take no part, nor do those of another than the most frequent length, of equally
    frequent ones the shortest: a table has one length, and to others a cosine isn't defined.
    """
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(usable)
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 0
    # A quotient is rounded once, so vectors of the same direction have the same quotients; 0.0 makes one zero of both.
    largest = F.array_max(F.transform("vector", F.abs))
    rows = rows.where(F.size("vector") == dim).withColumn("largest", largest).withColumn("way", F.transform("vector", lambda x: x / F.col("largest") + F.lit(0.0))).drop("largest")
    found, nodes = numbered(rows.select("way").distinct(), ("way",), "node", scope.place("ways"))
    ways = scope.stored(found.select("way", (F.col("node") - 1).alias("node")), "numbered_ways")
    return scope.stored(rows.join(ways, "way").select("vec_id", "vector", "node"), "numbered"), nodes, dim


def build_index(vectors: DataFrame, k: int = 30, sample: int = 12, least_change: float = 0.1, id_col: str = "vec_id", vector_col: str = "embedding", scope: Scope | None = None) -> tuple[Index, DataFrame]:
    """The graph of the ``k`` nearest found for every node, and the numbered vectors. A round that changes less than ``least_change`` of the edges is the last."""
    scope = Scope.of(scope, vectors)
    rows, nodes, dim = number_vectors(vectors, id_col, vector_col, scope)
    each = rows.groupBy("node").agg(F.any_value("vector").alias("vector")).withColumn("block", F.floor(F.col("node") / block_size(dim)))

    def first(block: pa.Table) -> pa.Table:
        block = block.sort_by("node")
        vecs = unit(np.array(block["vector"].to_pylist(), F64).reshape(-1, dim)).astype(F32)
        number, m = block["block"][0].as_py(), len(vecs)
        nbr, sim = np.full((m, k), -1, IDX), np.full((m, k), -2, F64)
        for i in range(0, m, FIRST):
            own = unit(vecs[i : i + FIRST])
            s = own @ own.T
            np.fill_diagonal(s, -3)
            n = min(k, len(own) - 1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :n]
            nbr[i : i + len(own), :n] = top + i + number * block_size(dim)
            sim[i : i + len(own), :n] = np.take_along_axis(s, top, 1)
        return _arrow(block=[number], vecs=[vecs.tobytes()], nbr=[nbr.tobytes()], sim=[sim.tobytes()], fresh=[(nbr >= 0).astype(np.uint8).tobytes()])

    graph = scope.stored(_grouped(each).applyInArrow(first, GRAPH), "graph")
    # As many edges as there can be: with few nodes a list isn't full.
    edges, round_ = nodes * min(k, max(nodes - 1, 0)), 0
    changed = edges
    while edges and changed >= least_change * edges:
        round_ += 1
        new = _descend(graph, dim, k, sample, round_, nodes, scope)
        scope.drop(graph)
        graph = new
        changed = graph.select(F.sum(F.length(F.replace(F.hex("fresh"), F.lit("00"), F.lit(""))) / 2)).first()[0] or 0
    return Index(graph, rows.select("vec_id", "node"), nodes, dim), rows


def _descend(graph: DataFrame, dim: int, k: int, sample: int, round_: int, nodes: int, scope: Scope) -> DataFrame:
    """One round of NN-descent, stored."""
    wide = sample + DRAWN

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g = _Graph(pa.Table.from_batches([batch.slice(i, 1)]), dim, k)
                rows, nbr, fresh = g.tried(sample, round_, nodes)
                # Of those that have a node as their neighbour, as many are sent as can be drawn for it, by what decides the draw.
                draw = np.random.default_rng((round_, g.block, 1)).random(len(nbr)).astype(F32)
                _, end = np.unique(2 * nbr + fresh, return_inverse=True)
                at, _ = _first_of_each(end, int(end.max(initial=-1)) + 1, wide, draw)
                parts = list(_cut(dim, nbr[at], nbr[at], rows[at] + g.start, fresh[at].astype(np.uint8), draw[at]))
                yield from _arrow(block=[b for b, _ in parts], **{c: [x[i].tobytes() for _, x in parts] for i, c in enumerate(("u", "v", "fresh", "draw"))}).to_batches()

    def candidates(own: pa.Table, sent: pa.Table) -> pa.Table:
        g = _Graph(own, dim, k)
        u, v, kind = _join(sent, "u", IDX), _join(sent, "v", IDX), _join(sent, "fresh", np.uint8).astype(bool)
        rows, nbr, fresh = g.tried(sample, round_, nodes)
        draw, lists = _join(sent, "draw", F32), []
        for which in (True, False):
            c = np.full((g.m, 2 * wide), -1, IDX)
            at, rank = _first_of_each(rows[fresh == which], g.m, wide, np.zeros(int((fresh == which).sum())))
            c[rows[fresh == which][at], rank] = nbr[fresh == which][at]
            back = np.flatnonzero(kind == which)
            at, rank = _first_of_each(u[back] - g.start, g.m, wide, draw[back])
            c[u[back][at] - g.start, wide + rank] = v[back][at]
            lists.append(c)
        wanted = np.unique(np.concatenate([x[x >= 0] for x in lists]))
        asks = list(_cut(dim, wanted, wanted))
        return _arrow(
            kind=[0, *[1] * len(asks)],
            block=[g.block, *(b for b, _ in asks)],
            src=[g.block] * (1 + len(asks)),
            a=[lists[0].tobytes(), *(x[0].tobytes() for _, x in asks)],
            b=[lists[1].tobytes(), *[b""] * len(asks)],
        )

    def served(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _arrow(block=[], ids=[], vecs=[], least=[])
        g = _Graph(own, dim, k)
        ids = [np.frombuffer(x, IDX) for x in asked["a"].to_pylist()]
        return _arrow(block=asked["src"].to_pylist(), ids=[x.tobytes() for x in ids], vecs=[g.vecs[x - g.start].tobytes() for x in ids], least=[g.sim[x - g.start, -1].tobytes() for x in ids])

    def paired(lists: pa.Table, fetched: pa.Table) -> pa.Table:
        ids, least = _join(fetched, "ids", IDX), _join(fetched, "least", F64)
        vecs = unit(_join(fetched, "vecs", F32).reshape(-1, dim))
        order = np.argsort(ids)
        ids, least, vecs = ids[order], least[order], vecs[order]
        row = lists.to_pylist()[0]
        new, old = (np.frombuffer(row[c], IDX).reshape(-1, 2 * wide) for c in "ab")
        out: list[tuple] = []
        for i in range(0, len(new), 256):
            a = new[i : i + 256]
            b = np.concatenate([a, old[i : i + 256]], axis=1)
            ia, ib = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (a, b))
            s = np.matmul(vecs[ia], vecs[ib].transpose(0, 2, 1))
            s[(a < 0)[:, :, None] | (b < 0)[:, None, :] | (a[:, :, None] == b[:, None, :])] = -3
            for near, mine, other in ((least[ia][:, :, None], 1, 2), (least[ib][:, None, :], 2, 1)):
                at = np.nonzero(s > near)
                ends = {1: a[at[0], at[1]], 2: b[at[0], at[2]]}
                out.append((ends[mine], ends[other], s[at]))
        found = nearest_k(*(np.concatenate(x) for x in zip(*out)), k) if out else (np.zeros(0, IDX), np.zeros(0, IDX), np.zeros(0, F64))
        parts = list(_cut(dim, found[0], *found))
        return _arrow(block=[b for b, _ in parts], dst=[x[0].astype(IDX).tobytes() for _, x in parts], other=[x[1].astype(IDX).tobytes() for _, x in parts], sim=[x[2].astype(F64).tobytes() for _, x in parts])

    def merged(own: pa.Table, updates: pa.Table) -> pa.Table:
        g = _Graph(own, dim, k)
        fresh = g.fresh.copy()
        rows, places, _, _ = g.sampled(sample, round_)
        fresh[rows, places] = False
        has = g.nbr >= 0
        dst = np.concatenate([np.nonzero(has)[0] + g.start, _join(updates, "dst", IDX)])
        src = np.concatenate([g.nbr[has], _join(updates, "other", IDX)])
        sim = np.concatenate([g.sim[has], _join(updates, "sim", F64)])
        d, s, v = nearest_k(dst, src, sim, k)
        rank = np.arange(len(d)) - np.searchsorted(d, d)
        nbr, near, new = np.full(g.nbr.shape, -1, IDX), np.full(g.sim.shape, -2, F64), np.zeros(g.nbr.shape, np.uint8)
        nbr[d - g.start, rank], near[d - g.start, rank] = s, v
        before = np.sort((np.nonzero(has)[0] << 40) + g.nbr[has])
        stale = np.sort((np.nonzero(has & ~fresh)[0] << 40) + g.nbr[has & ~fresh])
        key = ((d - g.start) << 40) + s
        within = lambda x: x[np.minimum(np.searchsorted(x, key), max(0, len(x) - 1))] == key if len(x) else np.zeros(len(key), bool)
        new[d - g.start, rank] = ~within(before) | (within(before) & ~within(stale))
        return _arrow(block=[g.block], vecs=[g.vecs.tobytes()], nbr=[nbr.tobytes()], sim=[near.tobytes()], fresh=[new.tobytes()])

    sent = graph.mapInArrow(ends, "block long, u binary, v binary, fresh binary, draw binary")
    lists = scope.stored(_grouped(graph).cogroup(_grouped(sent)).applyInArrow(candidates, "kind int, block long, src long, a binary, b binary"), "lists")
    fetched = _grouped(graph).cogroup(_grouped(lists.where("kind = 1"))).applyInArrow(served, "block long, ids binary, vecs binary, least binary")
    updates = _grouped(lists.where("kind = 0")).cogroup(_grouped(fetched)).applyInArrow(paired, "block long, dst binary, other binary, sim binary")
    out = scope.stored(_grouped(graph).cogroup(_grouped(updates)).applyInArrow(merged, GRAPH), "graph")
    scope.drop(lists)
    return out


def _adjacency(index: Index, k: int, back: int, scope: Scope) -> DataFrame:
    """``(block, vecs, at, ids)``: for each node its neighbours and the nearest ``back`` nodes that have it as theirs."""
    dim = index.dim

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g = _Graph(pa.Table.from_batches([batch.slice(i, 1)]), dim, k)
                rows, places = np.nonzero(g.nbr >= 0)
                # What a block has beyond these for a node, the node would not keep.
                end, own, near = nearest_k(g.nbr[rows, places], rows + g.start, g.sim[rows, places], back)
                parts = list(_cut(dim, end, end, own, near))
                yield from _arrow(block=[b for b, _ in parts], u=[x[0].tobytes() for _, x in parts], v=[x[1].tobytes() for _, x in parts], sim=[x[2].tobytes() for _, x in parts]).to_batches()

    def both(own: pa.Table, sent: pa.Table) -> pa.Table:
        g = _Graph(own, dim, k)
        rows, places = np.nonzero(g.nbr >= 0)
        dst, src, _ = nearest_k(_join(sent, "u", IDX), _join(sent, "v", IDX), _join(sent, "sim", F64), back)
        node, other = np.concatenate([rows, dst - g.start]), np.concatenate([g.nbr[rows, places], src])
        pair = np.unique(np.stack([node, other]), axis=1) if len(node) else np.zeros((2, 0), IDX)
        return _arrow(block=[g.block], vecs=[g.vecs.tobytes()], at=[np.searchsorted(pair[0], np.arange(g.m + 1)).astype(IDX).tobytes()], ids=[pair[1].astype(IDX).tobytes()])

    sent = index.graph.mapInArrow(ends, "block long, u binary, v binary, sim binary")
    return scope.stored(_grouped(index.graph).cogroup(_grouped(sent)).applyInArrow(both, "block long, vecs binary, at binary, ids binary"), "adjacency")


STATE = "query long, block long, vec binary, ids binary, sims binary, seen binary, open int"
ASK = "block long, asker binary, home binary, least binary, vec binary, at binary, ids binary"


class _Asks:
    """What some queries ask of a block: nodes ``ids``, each by the query at place ``at``. Of a query, its block, its vector and what it takes is known.

    One message from block to block carries all queries, however many there are.
    """

    def __init__(self, asker: np.ndarray, home: np.ndarray, least: np.ndarray, vecs: np.ndarray, at: np.ndarray, ids: np.ndarray):
        self.asker, self.home, self.least, self.vecs, self.at, self.ids = asker, home, least, vecs, at, ids

    @classmethod
    def read(cls, sent: pa.Table, dim: int) -> _Asks:
        places = [np.frombuffer(x, np.uint32).astype(IDX) for x in sent["at"].to_pylist()]
        counts = [len(x) // 8 for x in sent["asker"].to_pylist()]
        at = np.concatenate([np.zeros(0, IDX), *(x + n for x, n in zip(places, np.cumsum([0, *counts])))])
        asker, first, again = np.unique(_join(sent, "asker", IDX), return_index=True, return_inverse=True)
        return cls(asker, _join(sent, "home", IDX)[first], _join(sent, "least", F64)[first], _join(sent, "vec", F32).reshape(-1, dim)[first], again[at], _join(sent, "ids", IDX))

    def sent(self) -> pa.Table:
        rows = []
        for block, (at, ids) in _cut(self.vecs.shape[1], self.ids, self.at, self.ids):
            used, place = np.unique(at, return_inverse=True)
            rows.append((block, *(x[used].tobytes() for x in (self.asker, self.home, self.least, self.vecs)), place.astype(np.uint32).tobytes(), ids.tobytes()))
        c = list(zip(*rows)) or [[]] * 7
        return _arrow(**{name: list(x) for name, x in zip(("block", "asker", "home", "least", "vec", "at", "ids"), c)})


def search(index: Index, queries: DataFrame, width: int = 200, k: int = 30, back: int = 60, scope: Scope | None = None) -> DataFrame:
    """``(query, node, near)``: the ``width`` nearest nodes found for each of ``queries(query, vector, node)``, whose search starts at ``node``."""
    scope = Scope.of(scope, queries)
    dim = index.dim
    graph = _adjacency(index, k, back, scope)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = unit(np.array(batch.column("vector").to_pylist(), F64).reshape(-1, dim)).astype(F32)
            n = len(vecs)
            nodes = batch.column("node").to_numpy().astype(IDX)
            out = _arrow(query=batch.column("query").to_pylist(), block=(nodes // block_size(dim)).tolist(), vec=[v.tobytes() for v in vecs], ids=[x.tobytes() for x in nodes], sims=[np.ones(1, F64).tobytes()] * n, seen=[b"\0"] * n)
            yield from out.append_column("open", pa.array([1] * n, pa.int32())).to_batches()

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, least, new = batch.to_pylist(), [], []
            for r in rows:
                ids, sims, seen = np.frombuffer(r["ids"], IDX), np.frombuffer(r["sims"], F64), np.frombuffer(r["seen"], np.uint8)
                least.append(sims[-1] if len(sims) >= width else -2.0)
                new.append(ids[seen == 0])
            if rows:
                asker, home = (np.array([r[c] for r in rows], IDX) for c in ("query", "block"))
                vecs = np.concatenate([np.frombuffer(r["vec"], F32) for r in rows]).reshape(-1, dim)
                yield from _Asks(asker, home, np.array(least), vecs, np.repeat(np.arange(len(rows)), [len(x) for x in new]), np.concatenate(new)).sent().to_batches()

    def expanded(own: pa.Table, asked: pa.Table) -> pa.Table:
        a = _Asks.read(asked, dim)
        if len(a.ids):
            row = own.to_pylist()[0]
            at, ids = np.frombuffer(row["at"], IDX), np.frombuffer(row["ids"], IDX)
            x = a.ids - row["block"] * block_size(dim)
            n = at[x + 1] - at[x]
            found = ids[np.repeat(at[x] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            asker = np.repeat(a.at, n)
            order = np.lexsort((found, asker))
            asker, found = asker[order], found[order]
            new = np.ones(len(found), bool)
            new[1:] = (np.diff(found) != 0) | (np.diff(asker) != 0)
            a.at, a.ids = asker[new], found[new]
        return a.sent()

    def scored(own: pa.Table, asked: pa.Table) -> pa.Table:
        a = _Asks.read(asked, dim)
        rows: list[tuple] = []
        if len(a.ids):
            row = own.to_pylist()[0]
            vecs, theirs = unit(np.frombuffer(row["vecs"], F32).reshape(-1, dim)), unit(a.vecs)
            x, step = a.ids - row["block"] * block_size(dim), 1 << 16
            sims = np.concatenate([np.einsum("ij,ij->i", vecs[x[i : i + step]], theirs[a.at[i : i + step]]) for i in range(0, len(x), step)])
            near = sims > a.least[a.at]
            for home, found in _by(a.home[a.at[near]], a.asker[a.at[near]], a.ids[near], sims[near]):
                rows.append((home, *(y.tobytes() for y in found)))
        c = list(zip(*rows)) or [[]] * 4
        return _arrow(block=list(c[0]), asker=list(c[1]), ids=list(c[2]), sims=list(c[3]))

    def merged(states: pa.Table, found: pa.Table) -> pa.Table:
        asker = _join(found, "asker", IDX)
        order = np.argsort(asker, kind="stable")
        asker, more_ids, more_sims = asker[order], _join(found, "ids", IDX)[order], _join(found, "sims", F64)[order]
        rows = []
        for r in states.to_pylist():
            i, j = np.searchsorted(asker, [r["query"], r["query"] + 1])
            ids, sims = np.concatenate([np.frombuffer(r["ids"], IDX), more_ids[i:j]]), np.concatenate([np.frombuffer(r["sims"], F64), more_sims[i:j]])
            seen = np.zeros(len(ids), np.uint8)
            seen[: len(r["seen"])] = 1  # all that were there have been expanded now
            ids, first = np.unique(ids, return_index=True)
            sims, seen = sims[first], seen[first]
            order = np.lexsort((ids, -sims))[:width]
            rows.append((r["query"], r["block"], r["vec"], ids[order].tobytes(), sims[order].tobytes(), seen[order].tobytes(), int((seen[order] == 0).any())))
        c = list(zip(*rows)) or [[]] * 7
        out = _arrow(query=list(c[0]), block=list(c[1]), vec=list(c[2]), ids=list(c[3]), sims=list(c[4]), seen=list(c[5]))
        return out.append_column("open", pa.array(list(c[6]), pa.int32()))

    state = scope.stored(queries.select("query", "vector", "node").mapInArrow(begin, STATE), "state")
    while state.where("open > 0").limit(1).count():
        sent = state.where("open > 0").mapInArrow(asks, ASK)
        spread = _grouped(graph).cogroup(_grouped(sent)).applyInArrow(expanded, ASK)
        found = _grouped(graph).cogroup(_grouped(spread)).applyInArrow(scored, "block long, asker binary, ids binary, sims binary")
        new = scope.stored(_grouped(state).cogroup(_grouped(found)).applyInArrow(merged, STATE), "state")
        scope.drop(state)
        state = new

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, IDX) for x in batch.column("ids").to_pylist()]
            sims = _join(pa.Table.from_batches([batch]), "sims", F64)
            yield pa.record_batch({"query": np.repeat(batch.column("query").to_numpy(), [len(x) for x in ids]).astype(np.int64), "node": np.concatenate([np.zeros(0, IDX), *ids]), "near": sims})

    return state.mapInArrow(result, "query long, node long, near double")


def cosine(a: str, b: str) -> Column:
    """Of two columns of vectors of doubles; scaled only where squares would overflow or vanish."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, z: total + z)

    def measured(x: Column, y: Column) -> tuple[Column, Column]:
        return dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))

    def scaled(x: Column) -> Column:
        largest = F.array_max(F.transform(x, F.abs))
        return F.transform(x, lambda z: z / largest)

    (near, size), (near_scaled, size_scaled) = measured(F.col(a), F.col(b)), measured(scaled(F.col(a)), scaled(F.col(b)))
    return F.when((size > 1e-280) & (size < 1e300), near / size).otherwise(near_scaled / size_scaled)


def nearest(vectors: DataFrame, every: int = 50, top: int = 5, width: int = 200, k: int = 30, sample: int = 12, id_col: str = "vec_id", vector_col: str = "embedding", scope: Scope | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, the ``top`` nearest other rows found.

    All rows are indexed. ``score`` is the cosine of the original vectors in double precision; equal scores go by the smaller id. Null and zero
    vectors, those with null or non-finite components, of an odd length, or without an id take no part; vectors of equal direction are one node, of which the
    smallest ids are returned. With fewer candidates all are returned; a single vector, or none, gives no rows. Ids must differ.
    """
    scope = Scope.of(scope, vectors)
    index, rows = build_index(vectors, k, sample, id_col=id_col, vector_col=vector_col, scope=scope)
    queries = scope.stored(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query"), "vector", "node"), "queries")
    found = search(index, queries, width, k, scope=scope)
    # Nodes that rounding can't bring among the nearest don't matter; one node may hold the query alone.
    by_near = Window.partitionBy("query").orderBy(F.desc("near"), "node")
    within = F.nth_value("near", top + 1).over(by_near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    best = found.withColumn("least", within).where(F.col("least").isNull() | (F.col("near") >= F.col("least") - ROUNDING)).select("query", "node")
    # The smallest ids of each node, in two steps, since one direction may have very many rows.
    part = Window.partitionBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    heads = rows.withColumn("r", F.row_number().over(part)).where(F.col("r") <= top + 1)
    heads = heads.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= top + 1).select("node", "vec_id", "vector")
    pairs = best.join(heads, "node").where("vec_id != query").join(queries.select("query", F.col("vector").alias("own")), "query")

    return _ranked(pairs, top)


def _ranked(pairs: DataFrame, top: int) -> DataFrame:
    """The ``top`` of ``pairs(query, own, vec_id, vector)`` of each query."""
    exact = pairs.select(F.col("query").alias("query_id"), "vec_id", cosine("own", "vector").alias("score"))
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def exact_nearest(vectors: DataFrame, every: int = 50, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scope: Scope | None = None) -> DataFrame:
    """What :func:`nearest` approximates, by brute force: every block of queries meets every block of vectors. To measure recall with."""
    scope = Scope.of(scope, vectors)
    rows, _, dim = number_vectors(vectors, id_col, vector_col, scope)
    blocks = max(1, -(-rows.count() // BLOCK))

    def packed(rows: pa.Table) -> pa.Table:
        vecs = unit(np.array(rows["vector"].to_pylist(), F64).reshape(-1, dim))
        return pa.table({"block": rows["block"].slice(0, 1), "ids": pa.array([rows["vec_id"].to_numpy().astype(IDX).tobytes()], pa.binary()), "vecs": pa.array([vecs.tobytes()], pa.binary())})

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                queries, ids = np.frombuffer(r["queries"], IDX), np.frombuffer(r["ids"], IDX)
                s = np.frombuffer(r["own"], F64).reshape(-1, dim) @ np.frombuffer(r["vecs"], F64).reshape(-1, dim).T
                s[queries[:, None] == ids[None, :]] = -3
                order = np.argsort(ids)
                best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, : top + 3]]
                yield pa.record_batch({"query": np.repeat(queries, best.shape[1]), "vec_id": ids[best].ravel()})

    of = lambda df: df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").applyInArrow(packed, "block long, ids binary, vecs binary")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = of(asked).select(F.col("ids").alias("queries"), F.col("vecs").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    found = queries.join(of(rows), "block").select("queries", "own", "ids", "vecs").mapInArrow(met, "query long, vec_id long").where("query != vec_id")
    each = rows.select("vec_id", "vector")
    pairs = found.join(each, "vec_id").join(asked.select(F.col("vec_id").alias("query"), F.col("vector").alias("own")), "query")
    return _ranked(pairs, top)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
