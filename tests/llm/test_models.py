"""Trained operators: accuracy on rows held out, and defined results at the edges."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import language, neighbours, quality
from tidelog.llm.queries import QUERIES
from tidelog.llm.storage import table

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@needs_tables
def test_language_of_documents_held_out(spark):
    found = QUERIES["op6_language"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right, rows, rejected = found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.avg(F.col("rejected").cast("int"))).first()
    assert rows > 200 and right > 0.97 and rejected < 0.02


@needs_tables
def test_wrong_labels_do_not_reject_clean_documents(spark):
    docs = table(spark, SF, "documents")
    # Of 20 documents, one has the label of another language.
    others = F.expr("element_at(map('en', 'fr', 'fr', 'de', 'de', 'es', 'es', 'en'), lang)")
    noisy = docs.withColumn("lang", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(20)) == 3, F.coalesce(others, "lang")).otherwise(F.col("lang")))
    assert noisy.exceptAll(docs).count() > 20
    found = language.identify(docs.withColumnRenamed("lang", "truth"), language.fit_language_model(noisy, F.lit(True)))
    right, rejected = found.where(F.col("truth").isNotNull()).select(F.avg((F.col("truth") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right > 0.95 and rejected < 0.03


def test_language_edges(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog " * 5, "en"), ("le chat et le chien " * 5, "fr")] * 10)] + [(90, None, "en"), (91, "", None), (92, "123 !?", None), (93, "LE CHAT", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "extra": F.lit(1)})
    model = language.fit_language_model(docs, F.lit(True))
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(found[i]["lang_pred"] == x for i, _, x in rows[:20])
    assert [(found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) for i in (90, 91, 92)] == [("und", 0.0, True)] * 3
    assert found[93]["lang_pred"] == "fr" and found[93]["extra"] == 1
    assert language.fit_language_model(docs.where("false"), F.lit(True)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.where("false"), model).count() == 0


@needs_tables
def test_quality_of_labels_held_out(spark):
    found = QUERIES["op4_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    right = found["predicted"] == found["quality"]
    assert right.mean() > 0.95 and right[found["quality"] == 0].mean() > 0.9
    assert found["score"].between(0, 1).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "SHOUT!! " * 30), (None, "quiet words here"), (3, "SHOUT!! " * 30)], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(3, 0), (4, 1), (5, None), (1, 1)], "doc_id long, quality int")
    model = quality.fit_quality_model(docs, labels, F.lit(True))
    found = quality.score_quality(docs, model).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    none = quality.fit_quality_model(docs, labels.where("false"), F.lit(True))
    assert none.rules == () and quality.score_quality(docs.where("false"), none).count() == 0


def test_scores_of_quality_against_a_plain_version(spark):
    """Statistics, rules and the logistic, each computed again without Spark."""
    import math
    import re

    texts = ["", "Plain words, and more words.", "SHOUT!! 12 | 34\nSHOUT!! 12 | 34", "é À la carte; ok? 5€", None, "a  b\n\n c" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def plain(t):
        t = t or ""
        words, chars, lines, parts = len(re.findall(r"[^\x20\x09-\x0d]+", t)), len(t), t.split("\n"), t.split(" ")
        upper, digits = sum(c.isupper() for c in t), sum(c.isnumeric() for c in t)
        symbols = sum(not (c.isalpha() or c.isnumeric() or c in " \t\n\x0b\x0c\r.,") for c in t)
        per = lambda a, b: a / max(b, 1)
        return [math.log1p(words), per(chars, words), per(upper, chars), per(symbols, words), per(digits, chars), per(sum(t.count(c) for c in ".!?"), words), per(t.count(","), words), per(t.count("|"), words), per(len(lines), words), per(len(set(lines)), len(lines)), per(len(set(parts)), len(parts))]

    want = {i: plain(t) for i, t in enumerate(texts)}
    for r in quality.statistics(docs).collect():
        assert list(r)[1:] == pytest.approx(want[r["doc_id"]])
    rules = ((((0, True, 1.0), (3, False, 0.5)), 1.5), (((9, False, 0.9),), -2.0))
    model = quality.RuleModel(rules, ((1, 0.0, 6.0, 3.0, 2.0, 0.7),), -0.25)
    for r in quality.score_quality(docs, model).collect():
        x = want[r["doc_id"]]
        total = -0.25 + 1.5 * (x[0] > 1.0 and x[3] <= 0.5) - 2.0 * (x[9] <= 0.9) + (min(6.0, max(0.0, x[1])) - 3.0) / 2.0 * 0.7
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_scores_of_language_against_a_plain_version(spark):
    """Subwords, buckets, means and the softmax, each computed again one by one."""
    rng = np.random.default_rng(3)
    model = language.LanguageModel(("de", "en"), rng.normal(size=(1 << language.BUCKET_BITS, 2)).astype(np.float32), np.array([0.1, -0.2]), 0.7, 0.0)
    texts = ["The cat", "ein Über-Tier 5x", "a", "x  yz\nw", "mañana" * 30]

    def plain(text):
        data = [32, *(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()), 32]
        rows = []
        for n in language.SIZES:
            for i in range(len(data) - n + 1):
                part = data[i : i + n]
                if 32 in part[1:-1] or part[0] == part[-1] == 32:
                    continue
                code = part[0]
                for b in part[1:]:
                    code = (code * 0x01000193 & 0xFFFFFFFF) ^ b
                h = ((code ^ code >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
                h = ((h ^ h >> 12) * 0x297A2D39) & 0xFFFFFFFF
                rows.append(model.table[h >> 32 - language.BUCKET_BITS].astype(float))
        z = (np.mean(rows, axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        return model.languages[int(p.argmax())], float(p.max())

    found = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for t, r in zip(texts, found):
        name, score = plain(t)
        assert r["lang_pred"] == name and r["score"] == pytest.approx(score, abs=1e-6)


@needs_tables
@pytest.mark.parametrize("name", ["op4_quality", "op6_language"])
def test_null_ids_are_in_no_held_out_part_but_a_boolean(spark, tmp_path, name):
    docs = table(spark, SF, "documents").limit(300)
    docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id"))).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert found.count() == 300 and found.where("held_out IS NULL").count() == 0


def test_compiled_rules_score_as_the_model_does(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality.STATISTICS))
    found = np.array([r[0] for r in frame.select(model.score()).collect()])
    assert ((found >= 0.5) == (y == 1)).mean() > 0.97
    assert 0 < len(model.rules) < 200


def exact(vectors, every, top):
    rows = [(i, np.array(v, float)) for i, v in vectors if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in rows:
        if i % every == 0:
            scored = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w in rows if j != i)
            out[i] = scored[:top]
    return out


def test_neighbours_of_few_vectors_are_exact(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(20)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (404, [1.0]), (405, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    found = {}
    for r in neighbours.nearest(df, every=50, top=5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    want = exact(single, 50, 5)
    assert set(found) == set(want)
    for q, rows in want.items():
        assert [v for _, v in found[q]] == [v for _, v in rows]
        assert [-s for s, _ in found[q]] == pytest.approx([s for s, _ in rows], abs=1e-7)


def test_near_and_parallel_copies_are_told_apart(spark):
    """Groups that are closer together than single precision can tell, and vectors of one direction."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    x = [*(base + 1e-5 * rng.normal(size=(600, 16))), *(base * 2.0**k for k in range(-30, 30)), *rng.normal(size=(500, 16))]
    huge = [rng.normal(size=16) * 1e200, rng.normal(size=16) * 1e-200]
    vectors = [(i, v.tolist()) for i, v in enumerate([*x, *huge])]
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), every=20, top=5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    unit = neighbours.unit(np.array([v for _, v in vectors]))
    hits = 0
    for q, rows in found.items():
        s = unit @ unit[q]
        s[q] = -2
        if 600 <= q < 660:  # all of one direction: the smallest ids
            assert [i for i, _ in rows] == [i for i in range(600, 660) if i != q][:5]
        hits += len(set(np.argsort(-s, kind="stable")[:5].tolist()) & {i for i, _ in rows})
        assert all(abs(v - s[i]) < 1e-12 for i, v in rows)
    assert len(found) == len(vectors) // 20 + 1 and hits / (5 * len(found)) >= 0.9


def test_neighbours_of_one_vector_or_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df).count() == 0 and neighbours.nearest(df.where("false")).count() == 0


def test_recall_over_several_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    exact = neighbours.exact_nearest(df, every=100, top=5).cache()
    unit = neighbours.unit(x)
    want = {(q, i) for q in range(0, 9000, 100) for i in [i for i in np.argsort(-(unit @ unit[q])).tolist() if i != q][:5]}
    assert {(r["query_id"], r["vec_id"]) for r in exact.collect()} == want
    assert neighbours.recall(neighbours.nearest(df, every=100, top=5, width=100), exact) >= 0.9


@needs_tables
def test_descent_finds_the_neighbours_of_a_small_table_too(spark):
    vectors = table(spark, SF, "embeddings")
    index, _ = neighbours.build_index(vectors)
    assert index.nodes < neighbours.BLOCK
    assert neighbours.recall(neighbours.nearest(vectors), neighbours.exact_nearest(vectors)) == 1.0


def test_long_vectors_come_in_smaller_blocks(spark):
    rng = np.random.default_rng(3)
    # A hub: what all others lie around.
    x = rng.normal(size=(300, 512)) * 0.5
    x[0] = 0
    x += rng.normal(size=512)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert neighbours.block_size(1024) == 128 and neighbours.block_size(64) == neighbours.block_size(1) == neighbours.BLOCK
    assert neighbours.recall(neighbours.nearest(df, every=20, top=5, width=60), neighbours.exact_nearest(df, every=20, top=5)) >= 0.9


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0]), (100, [0.0, 1.0]), (3, [0.0, 1.0, 1.0])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == {(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)}
