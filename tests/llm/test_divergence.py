"""Distances of sources against a plain version, and the tree of counts against the matrix."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_version(rows, least=10, top=10):
    counts, docs, groups = {}, {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        found = TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        for t in found:
            counts[lang, source, t] = counts.get((lang, source, t), 0) + 1
        for t in set(found):
            docs[lang, t] = docs.get((lang, t), 0) + 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (g, t), n in docs.items() if g == lang and n >= least]
        of = lambda s, t: counts.get((lang, s, t), 0)
        all_of = {t: sum(of(s, t) for s in sources) for t in kept}
        p = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * len(kept))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        shares = {s: {t: p(of(s, t), sum(of(s, x) for x in kept)) for t in kept} for s in sources}
        whole = {t: p(all_of[t], sum(all_of.values())) for t in kept}
        for s in sources:
            parts = {
                "pair": [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in sources - {s}],
                "term": sorted((-f(shares[s][t], whole[t]), t.encode(), t) for t in kept if of(s, t) and shares[s][t] > whole[t])[:top],
            }
            out |= {(lang, s, part, item, -v, r + 1) for part, own in parts.items() for r, (v, _, item) in enumerate(sorted(own))}
    return out


def corpus():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"] + ["élan", "Élan", "漢字", "The", "the", "x" * 3000]
    text = lambda: " ".join(rng.choices(words, weights=[1 + (k % 7) ** 2 for k in range(len(words))], k=rng.randint(0, 60))).replace(" ", rng.choice([" ", "1", "\n", "_"]))
    rows = [(rng.choice(["en", "en", "fr", None]), rng.choice(["a", "b", "B", "ä", None, "hot", "hot", "hot"]), rng.choice([text, text, text, lambda: None, lambda: ""])()) for _ in range(400)]
    return rows + rows[:20] + [("xx", "one", "word"), ("xx", "two", None), ("yy", "alone", "1 2 3"), ("en", "long", " ".join(rng.choices(words, k=30_000)))]


@pytest.mark.parametrize(("strip", "tile", "slice_bytes"), [(4096, 96, 1 << 19), (16, 3, 2000)])
def test_source_divergence(spark, monkeypatch, strip, tile, slice_bytes):
    for name, value in (("STRIP", strip), ("TILE", tile), ("SLICE_BYTES", slice_bytes), ("AT_ONCE", 64)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "value long, lang string, source string, text string, term long").repartition(3)
    found = divergence.source_divergence(docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_version(rows)


def test_no_rows(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


@pytest.mark.parametrize(("rows", "columns", "border"), [(1, 1, 0), (5, 40, 0), (9, 3, 4), (33, 64, 0), (12, 100, 1), (4, 0, 0), (6, 9, 5)])
def test_tree_gives_what_the_matrix_gives(rows, columns, border):
    rng = np.random.default_rng(rows)
    matrix = rng.integers(0, 50, (rows, columns)) * (rng.random((rows, columns)) < 0.2)
    row, column = np.nonzero(matrix)
    tree = divergence.QuadTree(row, column, matrix[row, column], rows, columns)
    total = matrix.sum(1)
    price = lambda n, t: divergence.price(n, t, columns)
    sums = tree.pair_sums(price(tree.counts, total[tree.cell_row]), price(np.zeros(rows, np.int64), total), border)
    p = price(matrix, total[:, None])
    for a in range(rows):
        for b in range(a + 1, rows):
            if not border or a < border <= b:
                assert sums[a, b] == divergence.distance(p[a], p[b]).sum()


def test_shares_are_exact():
    n = np.array([0, 7, 10**12, 5 * 10**17])
    assert divergence.price(n, np.full(4, 6 * 10**17), 1000).tolist() == [1 + 10**9 * (x + 2) // (6 * 10**17 + 2000) for x in n.tolist()]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Ab cd-ab " * 50 + "z" * 300 + " ab"
    want = None
    for limit in (10_000, 64, 1):
        monkeypatch.setattr(divergence, "SLICE_BYTES", limit)
        group, n, docs, terms = divergence.count_terms(pa.array([text, None, "cd", "q"]), np.array([0, 0, 0, 1]))
        found = sorted(zip(terms.to_pylist(), group.tolist(), n.tolist(), docs.tolist()))
        assert want in (None, found)
        want = found
    assert want == [("ab", 0, 101, 1), ("cd", 0, 51, 2), ("q", 1, 1, 1), ("z" * 300, 0, 1, 1)]


def test_a_worker_holds_little_beside_the_texts_it_counts():
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(26) for b in range(26) for c in range(3)])
    words = vocabulary[rng.integers(0, len(vocabulary), (8000, 200))]
    texts, groups = pa.array([" ".join(x) for x in words]), np.arange(8000) % 5
    tracemalloc.start()
    try:
        group, n, docs, terms = divergence.count_terms(texts, groups)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    _, which = np.unique(words, return_inverse=True)
    which = which.reshape(words.shape)
    want_n, want_docs = np.zeros((2, 5, which.max() + 1), np.int64)
    for g in range(5):
        want_n[g] = np.bincount(which[groups == g].ravel(), minlength=want_n.shape[1])
    for g, own in zip(groups, which):
        want_docs[g, np.unique(own)] += 1
    place = {t: k for k, t in enumerate(sorted(vocabulary.tolist()))}
    at = [place[t] for t in terms.to_pylist()]
    assert len(n) == np.count_nonzero(want_n) and (want_n[group, at] == n).all() and (want_docs[group, at] == docs).all()
    assert peak < 8 * texts.nbytes
