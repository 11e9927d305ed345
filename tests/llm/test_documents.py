"""Operators on documents against plain versions, with nulls, empty and long texts, ties, repeated rows and no rows."""

import hashlib
import random
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidelog.llm import chunks, jaccard, known_licenses, language, licenses, mixing, packing, queries, repeats, spotsigs, tokens  # noqa: E402
from tidelog.llm.storage import Scope  # noqa: E402
from tidelog.scratch import shared_dir  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, items string"


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and", "is", "élan", "\x01odd"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = prose(150), prose(60)
    texts = [None, "", " \t\n ", "one", "One", "two words", "a b c d e", "A  b\nc d\te", "x" * 5000, prose(3000)]
    texts += [base] * 4 + [base.replace("w1 ", "W1  ")]
    for k in range(1, 12):  # near copies, from close to far
        w = base.split(" ")
        for i in rng.sample(range(len(w)), k):
            w[i] = f"new{k}_{i}"
        texts.append(" ".join(w))
    texts += [prose(rng.randint(5, 200)) for _ in range(25)]
    texts += [f"{prose(30)}\n{passage} {prose(20)}" for _ in range(8)]
    texts += [" ".join(passage.split(" ")[:25] * 3), passage]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [rows[20], (None, base), (None, None)]


def frame(spark, rows, source="s"):
    sources = ["a", None, "b", "ä", "B"]
    return spark.createDataFrame([(i, t, None, sources[k % 5], None, -1, 0.5, "clash") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def test_jaccard_components(docs, rows):
    sets = [brute.shingles(t) for _, t in rows]
    want = sorted((-1 if i is None else i, len(s), i if c is None else c) for (i, _), s, c in zip(rows, sets, brute.components([i for i, _ in rows], sets)))
    want = [(i, n, c if c is not None else -1) for i, n, c in want]
    found = jaccard.jaccard_components(docs).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in found) == sorted(want)


def test_drop_near_duplicates(docs, rows):
    sets = [brute.shingles(t) for _, t in rows]
    label = brute.components([i for i, _ in rows], sets)
    # Linked rows share a label; those without a set stay, repeated or not.
    want = len({c for c, s in zip(label, sets) if s}) + sum(not s for s in sets)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert len(found) == want
    assert {r["doc_id"] for r in found if r["text"] and r["text"].strip()} == {c for c, s in zip(label, sets) if s}


def test_remove_repeats(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = sorted((-1 if i is None else i, len(brute.words(t)), n, " ".join(kept)) for (i, t), (kept, n) in zip(order, brute.removed(order)))
    found = repeats.remove_repeats(docs)
    assert found.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()) == want


def test_mixing(docs, rows):
    planned = mixing.plan_mix(docs).collect()
    assert len(planned) == len(rows)
    sizes = {}
    for r in planned:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute.targets(sizes, (5, 2, 1), 3)
    for r in planned:
        assert r["size"] == len(brute.words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 3
        assert int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(docs)
    assert again.columns == docs.columns and again.count() == sum(r["copies"] for r in planned)


def test_mixing_comes_near_its_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("source"))
    sums = mixing.plan_mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.05 for r in sums)


def test_packing(spark):
    sizes = [(i, (i * 37) % 900) for i in range(400)] + [(7, 259), (7, 10_000), (None, 5), (8, None), (9, -3)] + [(3, 111)] * 3
    found = packing.pack(spark.createDataFrame(sizes, "doc_id long, size long"), permitted=(64, 256, 1024)).collect()
    assert sum(r["length"] for r in found) == sum(max(0, n or 0) for _, n in sizes)
    assert all(0 < r["length"] <= 1024 for r in found)
    assert len({(r["doc_id"], r["copy"], r["piece"]) for r in found}) == len(found)
    bins = {}
    for r in found:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        used = 0
        for r in own:
            assert r["bin_offset"] == used
            used += r["length"]
        assert all(r["bin_used"] == used and r["bin_capacity"] == min(c for c in (64, 256, 1024) if c >= used) for r in own)
    assert sum(own[0]["bin_capacity"] for own in bins.values()) <= 1.15 * sum(r["length"] for r in found)


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, capacity, used = packing.best_fit(packing.np.array([60, 50, 40, 30, 10]), [100], lambda c: c)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 60, 50, 80] and capacity == [100, 100] and used == [100, 90]


def test_packing_costs_little_more_than_the_best(spark):
    rng = random.Random(4)
    over = []
    for _ in range(60):
        lengths = sorted((rng.randint(20, 1000) for _ in range(rng.randint(1, 7))), reverse=True)
        _, _, capacity, used = packing.best_fit(packing.np.array(lengths), (256, 512, 1024), packing.quadratic_cost)
        assert sum(used) == sum(lengths) and all(u <= c for u, c in zip(used, capacity))
        over.append(sum(map(packing.quadratic_cost, capacity)) / brute.least_cost(lengths, (256, 512, 1024), packing.quadratic_cost))
    assert max(over) < 1.35 and sum(over) / len(over) < 1.03


def test_packing_does_not_depend_on_the_cluster(spark):
    sizes = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") * 37 % 900).alias("size"))
    pack = lambda: {(r["doc_id"], r["bin_id"], r["bin_offset"]) for r in packing.pack(sizes).collect()}
    first = pack()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert pack() == first
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pieces_just_over_half_of_a_length_open_longer_bins():
    _, _, capacity, used = packing.best_fit(packing.np.full(600, 520), (512, 1024, 2048, 4096), packing.quadratic_cost)
    assert sum(used) == 600 * 520 and sum(map(packing.quadratic_cost, capacity)) / sum(used) < 1.7


def scanned(spark, rows):
    return licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_digests(spark)).collect()


def test_licenses(spark):
    notice = "Released under the MIT License."
    mit = next(t for n, t in known_licenses.TEXTS if n == "MIT" and len(t) > 500)
    rows = [(1, notice), (2, "Copyright (c) 2020 X\n" + mit.replace("license", "licence").upper()), (3, "prose\n  released UNDER the mit licence\nmore"), (4, None), (5, "copyright 2020"), (6, f"{notice} And more."), (1, notice), (None, "x\nLicensed under CC BY-NC 4.0."), (7, "the licence licence terms"), (8, "the license license terms")]
    found = scanned(spark, rows)
    got = {r["doc_id"]: (r["license"], r["line_licenses"], r["n_rows"]) for r in found}
    assert got == {1: ("MIT", ["MIT"], 2), 2: ("MIT", ["MIT"], 1), 3: (None, ["MIT"], 1), 4: (None, [], 1), 5: (None, [], 1), 6: (None, [], 1), None: (None, ["CC-BY-NC-4.0"], 1), 7: (None, [], 1), 8: (None, [], 1)}
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["doc_id"] for r in found if r["digest"] == empty} == {4, 5}
    assert len({r["digest"] for r in found if r["doc_id"] in (7, 8)}) == 1


@pytest.mark.parametrize("width", [40, 72, 100])
def test_licence_files_however_they_are_wrapped(spark, width):
    titles = {"MIT": "MIT License", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}
    wrap = lambda t: "\n".join(" * " + x for x in textwrap.wrap(t, width))
    whole = [(n, t) for n, t in known_licenses.TEXTS if len(t) > 300]
    rows = [(i, f"{titles.get(n, '')}\n\nCopyright (c) 1999-2024, Some Holder <some@example.org>\n(c) Copyright 2001 by another\nAll rights reserved.\n\n{wrap(t)}\n") for i, (n, t) in enumerate(whole)]
    assert [(r["doc_id"], r["license"]) for r in sorted(scanned(spark, rows))] == [(i, n) for i, (n, _) in enumerate(whole)]


def test_what_source_files_say(spark):
    mit = next(t for n, t in known_licenses.TEXTS if n == "MIT" and len(t) > 500)
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law'
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    comment = lambda mark, text: "\n".join(f"{mark} {x}" for x in text.split("\n"))
    rows = [
        (1, "MIT License\n\nCopyright The Kubernetes Authors.\n\n" + mit),
        (2, "// SPDX-License-Identifier: MIT\npackage main"),
        (3, "/*\n" + comment(" *", apache) + "\n */\nint main() {}"),
        (4, comment("#", "Copyright Some Person\n\n" + gpl) + "\n\nimport os"),
        (5, "# SPDX-License-Identifier: GPL-2.0-or-later"),
        (6, "copyright notice\nand nothing else of note"),
        (7, "Copyright\ncopyright holders"),
        (8, "SPDX-License-Identifier: made up"),
        (9, apache.replace("Version 2.0", "Version 2.1")),
        (10, "one line\n\n\n" + mit[:80] + "\n" + mit[80:] + "\n\nanother"),
    ]
    found = {r["doc_id"]: (r["license"], r["line_licenses"]) for r in scanned(spark, rows)}
    assert found == {1: ("MIT", ["MIT"]), 2: (None, ["MIT"]), 3: (None, ["Apache-2.0"]), 4: (None, ["GPL-3.0"]), 5: ("GPL-2.0", ["GPL-2.0"]), 6: (None, []), 7: (None, []), 8: (None, []), 9: (None, []), 10: (None, ["MIT"])}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence files here")
def test_digests_of_whole_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0-Perl"}
    rows = [(i, Path("/usr/share/common-licenses", f).read_text(errors="replace")) for i, f in enumerate(names)]
    again = [(100 + i, "\r\n".join(textwrap.wrap(" ".join(t.split()), 60))) for i, t in rows if names[list(names)[i]] == "MPL-2.0"]
    found = {r["doc_id"]: r["license"] for r in scanned(spark, rows + again)}
    assert [found[i] for i in range(len(names))] == list(names.values()) and all(found[i] == "MPL-2.0" for i, _ in again)


def test_tokens(docs, rows):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = tokens.tokenizer(path)
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    found = tokens.count_tokens(docs, path, chunk=500, overlap=8).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in found) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)


@pytest.mark.parametrize("text", ["it's we'll  \n\n x " * 400, "a" * 9000, "<|endoftext|>" * 700, "é漢字 \U0001f600" * 900, "  \n" * 3000, "word's  1234 " * 900])
def test_spliced_chunks_count_as_the_whole(text):
    public = pytest.importorskip("public_tokenizers")
    library = tokens.tokenizer(public.path("byte_bpe_50k.json"))
    encode = lambda t: library.encode(t, add_special_tokens=False)
    want = len(encode(text).ids)
    assert [tokens.count_huge(text, encode, c, o) for c, o in ((200, 4), (1000, 64), (5000, 512))] == [want] * 3
    if tokens.PLAIN.fullmatch(text):
        assert len(tokens.plain_encoder(public.path("byte_bpe_50k.json")).encode(text, allowed_special="all")) == want


def test_plain_texts_are_encoded_alike():
    public = pytest.importorskip("public_tokenizers")
    from hypothesis import given, settings
    from hypothesis import strategies as st

    path = public.path("byte_bpe_50k.json")
    library, plain = tokens.tokenizer(path), tokens.plain_encoder(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(codec="utf-8", max_codepoint=0x24F), max_size=200))
    def same(text):
        if tokens.PLAIN.fullmatch(text):
            assert plain.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids

    same()


def test_spotsigs_probe(docs, rows):
    key = lambda x: -1 if x is None else x
    anchors = set(spotsigs.ANCHORS.split())
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = spotsigs.probe_edits(docs).collect()
    own = [brute.spots(t, anchors) for _, t in order]
    label = brute.components([i for i, _ in order], own)
    want = []
    for k, (i, t) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        spots = brute.spots(edited, anchors)
        sizes = (16 * len(own[k]), 16 * len(spots))
        want.append((key(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), *sizes, brute.likeness(own[k], spots), brute.likeness(own[k], own[(k + 1) % len(own)]), key(i if label[k] is None else label[k])))
    got = [(key(r[0]), r[1], r[2], len(r["fingerprint"]), len(r["edited_fingerprint"]), r["near_edited"], r["near_next"], key(r["component_id"])) for r in found]
    assert sorted(got) == sorted(want)
    by_text = {}
    plain = {key(r["doc_id"]): r["fingerprint"] for r in found if r["doc_id"] is not None}
    for i, t in order:
        if i is not None:
            by_text.setdefault(t, set()).add(plain[i])
    assert all(len(x) == 1 for x in by_text.values())


def test_similar_fingerprints(docs, rows):
    key = lambda x: -1 if x is None else x
    anchors = set(spotsigs.ANCHORS.split())
    sets = [brute.spots(t, anchors) for _, t in rows]
    label = brute.components([i for i, _ in rows], sets)
    want = sorted((key(i), len(s), key(i if c is None else c)) for (i, _), s, c in zip(rows, sets, label))
    assert sorted((key(r[0]), r[1], key(r[2])) for r in spotsigs.similar(docs).collect()) == want
    prints = {r["doc_id"]: len(r["fingerprint"]) for r in spotsigs.fingerprints(docs).collect()}
    assert all(prints[i] == 16 * len(s) for (i, _), s in zip(rows, sets) if i is not None)


def test_spotsigs_query_finds_near_copies_that_are_not_neighbours(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda: " ".join(f"the w{rng.randrange(10**6)} v{rng.randrange(10**6)}" for _ in range(60))
    base = prose()
    rows = [(i, prose()) for i in range(40)]
    rows[5], rows[30], rows[38] = (5, base), (30, base + " the last word"), (38, base)
    rows += [(50, None), (38, base), (None, base)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op8_spotsigs(spark, str(tmp_path))
    got = [(r["doc_id"], r["component_id"]) for r in found.collect()]
    assert len(got) == len(rows)
    assert sorted(got, key=str) == sorted(((i, 5 if t and t.startswith(base) else i) for i, t in rows), key=str)


def test_a_signature_is_an_anchor_and_its_chain():
    import pyarrow as pa

    a, b, c, d = spotsigs.signature_sets(pa.array(["The Big dog, of big dog", "big the dog! of big (dog)", "", None]))
    assert len(a) == 2 and len(b) == 2 and len(set(a) & set(b)) == 1 and not len(c) and not len(d)


CLASHES = ("row", "chunk", "id", "content", "rest", "__row", "__chunk", "__id", "__text", "__target", "__source", "__source_size", "__copy", "number", "part", "place", "has_letter", "SIZE", "source_size", "target", "rate", "copies", "key", "kind", "range", "digest", "label", "keep", "v", "bin_id")


@pytest.mark.parametrize("operator", [jaccard.drop_near_duplicates, repeats.remove_repeats, mixing.mix, mixing.plan_mix, lambda d: language.identify(d, None)])
def test_columns_with_the_names_of_internals_keep_their_values(docs, operator):
    named = docs.drop("size", "score", "items", "n_chars").withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES})
    out = operator(named)
    replaced = {c for c in out.columns if c.lower() in ("source_size", "target", "rate", "copies")} if operator is mixing.plan_mix else set()
    same = [c for c in CLASHES if c not in replaced and c != "SIZE" * (operator is mixing.plan_mix)]
    found = out.select("doc_id", *[F.col(f"`{c}`") for c in same]).collect()
    assert found and all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in found for c in same)


def test_columns_keep_their_types(docs):
    typed = docs.withColumns({"text": F.col("text").cast("varchar(100000)"), "n": F.struct(F.lit(1).alias("a")), "l": F.array(F.lit(1.5))})
    for operator in (jaccard.drop_near_duplicates, repeats.remove_repeats):
        out = operator(typed)
        assert out.select(*typed.columns).dtypes == typed.dtypes and {(r["n"]["a"], *r["l"]) for r in out.collect()} == {(1, 1.5)}


def test_very_long_texts(spark):
    rng = random.Random(1)
    long = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=1_700_000))
    rows = [(1, long), (2, "short " * 30), (3, long + " end"), (4, None), (5, long[:200])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert len(long) > 9_000_000
    found = jaccard.jaccard_components(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    n = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeats.remove_repeats(docs).drop("text", "kept_text").collect()}
    assert n[1] == (1_700_000, 0) and n[3][1] >= 1_700_000 and n[5][1] >= 20 and n[2] == (30, 29) and n[4] == (0, 0)
    assert chunks.chunk_table(docs, F.col("text"), "doc_id", 20_000_000, Scope(spark), []).select("chunk").distinct().count() >= 2


def test_chunks_are_cut_by_bytes(spark):
    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 100 * 300).cast("int")).alias("text")).repartition(2)
    total = chunks.text_bytes(texts)
    found = chunks.chunk_table(texts, F.col("text"), "doc_id", total, Scope(spark), []).groupBy("chunk").agg(F.sum(F.length("content")).alias("n"), F.min("row").alias("row"), F.count("*").alias("rows")).collect()
    assert sum(r["n"] for r in found) == total and sum(r["rows"] for r in found) == 3000 and len(found) > 10
    assert all(r["n"] <= chunks.LEAST_CHUNK + 30_000 and r["row"] == r["chunk"] for r in found)


def test_hot_passages_over_many_chunks(spark, monkeypatch):
    """A passage in every text, many chunks, and more shards than partitions."""
    monkeypatch.setattr(chunks, "LEAST_CHUNK", 3000)
    monkeypatch.setattr(chunks, "chunk_bytes", lambda total: 3000)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "d"], k=40)) + f" u{i} {passage} " + ("same text " * 30 if i % 3 == 0 else f"v{i}")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = [brute.shingles(t) for _, t in rows]
    want = [c if c is not None else i for (i, _), c in zip(rows, brute.components([i for i, _ in rows], sets))]
    assert [r["component_id"] for r in jaccard.jaccard_components(docs).orderBy("doc_id").collect()] == want
    found = repeats.remove_repeats(docs).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["kept_text"]) for r in found] == [(n, " ".join(kept)) for kept, n in brute.removed(rows)]


def _files(spark):
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidelog")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in files.listStatus(place)} if files.exists(place) else set()


def test_a_scope_deletes_its_own_files_and_no_others(spark, docs):
    kept = jaccard.jaccard_components(docs)
    before, tables = _files(spark), len(spark.catalog.listTables())
    with Scope(spark) as scope:
        for operator in (jaccard.jaccard_components, jaccard.drop_near_duplicates, repeats.remove_repeats, mixing.mix, spotsigs.probe_edits, spotsigs.similar):
            assert operator(docs, scope=scope).count() > 0
        packing.pack(docs.select("doc_id", "size"), scope=scope).count()
        assert _files(spark) > before
    assert _files(spark) == before and len(spark.catalog.listTables()) == tables
    assert kept.count() == docs.count()


@pytest.mark.parametrize(
    "operator",
    [
        jaccard.jaccard_components,
        jaccard.drop_near_duplicates,
        repeats.remove_repeats,
        mixing.mix,
        spotsigs.probe_edits,
        spotsigs.similar,
        lambda d: tokens.count_tokens(d, __import__("public_tokenizers").path("byte_bpe_50k.json")),
        lambda d: packing.pack(d.select("doc_id", "size")),
        lambda d: licenses.scan_licenses(d, licenses.known_digests(d.sparkSession)),
    ],
)
def test_no_rows(docs, operator):
    assert operator(docs.where("false")).count() == 0
