"""The pipeline's stages against plain versions, and the registered queries against SQL."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidelog.llm import mixing  # noqa: E402
from tidelog.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from tidelog.llm.storage import Scope, table  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_each_stage_does_its_work(spark):
    docs = table(spark, SF, "documents")
    seen, scope = [docs.toPandas()], Scope(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        docs = scope.stored(out, name)
        seen.append(docs.toPandas())
    first, known, different, trimmed, mixed, packed = seen
    assert len(known) >= 0.98 * len(first[first["text"].str.contains("[a-z]", na=False)])

    sets = [brute.shingles(t) for t in known["text"]]
    label = brute.components(known["doc_id"].tolist(), sets)
    assert sorted(different["doc_id"]) == sorted(set(label))

    order = sorted(zip(different["doc_id"], different["text"]))
    want = {i: (t if not n else " ".join(kept)) for (i, t), (kept, n) in zip(order, brute.removed(order)) if not n or kept}
    assert dict(zip(trimmed["doc_id"], trimmed["text"])) == want
    assert (trimmed["n_chars"] == trimmed["text"].str.len()).all()

    sizes = {}
    for s, t in zip(trimmed["source"], trimmed["text"]):
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    targets = brute.targets(sizes, (5, 2, 1), 3)
    copies = mixed.groupby("doc_id").size()
    for i, s, t in zip(trimmed["doc_id"], trimmed["source"], trimmed["text"]):
        rate = targets[s] / sizes[s] if sizes[s] else 0
        assert int(rate + 1e-9) <= copies.get(i, 0) <= int(rate) + 1

    assert packed["length"].sum() == sum(len(brute.words(t)) for t in mixed["text"])
    assert (packed["bin_used"] <= packed["bin_capacity"]).all()
    assert (packed.groupby("bin_id")["length"].sum() == packed.groupby("bin_id")["bin_used"].first()).all()


def test_run_gives_the_last_stage(spark):
    assert "bin_id" in corpus_pipeline.run(spark, SF).columns


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    show = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert show(tuple(r[c] for c in names) for r in found.collect()) == show(want.fetchall())


def test_draws_are_even(spark):
    from pyspark.sql import functions as F

    low, mean = spark.range(5000).select((mixing.draw("s", F.col("id"))).alias("d")).agg(F.count_if(F.col("d") < 0.25) / 5000, F.avg("d")).first()
    assert abs(low - 0.25) < 0.03 and abs(mean - 0.5) < 0.03
