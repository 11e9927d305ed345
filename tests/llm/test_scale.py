"""What holds however large a corpus is: bounded numbers of tasks, and nothing left behind."""

import os

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidelog.llm import jaccard, repeats, sketch, spotsigs
from tidelog.llm.queries import QUERIES
from tidelog.llm.storage import Scope, table
from tidelog.scratch import shared_dir

SF = "/root/testdata/sf0.001"


def folders(spark):
    place = f"{shared_dir(spark).removeprefix('file://')}/tidelog"
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def warehouse(spark):
    place = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def show(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["jaccard", "repeats", "spotsigs"])
def test_many_shards_meet_in_few_tasks(spark, monkeypatch, name):
    docs = table(spark, SF, "documents")
    run = {"jaccard": (jaccard.jaccard_components, ("doc_id", "component_id")), "repeats": (repeats.remove_repeats, ("doc_id", "n_removed")), "spotsigs": (spotsigs.probe_edits, ("doc_id", "near_next", "component_id"))}
    f, columns = run[name]
    want = show(f(docs), columns)
    monkeypatch.setattr(sketch, "MOST_PARTS", 5)
    monkeypatch.setattr(spotsigs, "MOST_RANGES", 3)
    for module in (sketch, repeats):
        monkeypatch.setattr(module, "shard_count", lambda total: 100_000)
    assert show(f(docs), columns) == want


def test_a_message_for_each_part():
    texts = pa.array([b"a", b"b", b"c"], pa.binary())
    batch = sketch.packed(7, np.array([0, 1, 99_999]), 100_000, cells=texts)
    assert batch.column("part").to_pylist() == [0, 19_999] and batch.column("chunk").to_pylist() == [7, 7]
    assert [[m["shard"] for m in x] for x in batch.column("messages").to_pylist()] == [[0, 1], [99_999]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op1_jaccard", "op8_spotsigs", "op9_neighbours", "op10_repeats"])
def test_queries_store_in_the_shared_folder_alone(spark, name):
    before = warehouse(spark)
    QUERIES[name](spark, SF).count()
    assert warehouse(spark) == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_a_run_of_the_pipeline_leaves_its_last_stage_alone(spark):
    before = folders(spark)
    out = corpus_pipeline.run(spark, SF)
    n = out.count()
    assert n and len(folders(spark) - before) <= 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_over_one_folder_are_apart(spark):
    docs = table(spark, SF, "documents")
    one = corpus_pipeline.near_duplicates_stage(spark, docs.where("lang = 'en'"), SF)
    other = corpus_pipeline.near_duplicates_stage(spark, docs.where("lang != 'en'"), SF)
    assert one.count() > 0 and other.count() > 0 and one.count() > 0


def test_a_scope_goes_with_all_that_it_stored(spark):
    before = folders(spark)
    with pytest.raises(RuntimeError), Scope(spark) as scope:
        scope.stored(spark.range(3), "x")
        assert scope.bucketed(spark.range(10), 3, "id", "y").count() == 10
        raise RuntimeError
    assert folders(spark) == before and not any(t.name.startswith("tidelog_y") for t in spark.catalog.listTables())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_queries_of_empty_tables_have_no_rows(spark, tmp_path):
    for name in ("documents", "labels", "embeddings", "conversations"):
        table(spark, SF, name).limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = {name: query(spark, str(tmp_path)).count() for name, query in QUERIES.items()}
    assert found == {name: int(name == "op13_chat") for name in QUERIES}


EDGES = "doc_id long, text string, lang string, source string, n_chars long, row long, component long, rest string"


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_at_the_edges(spark, stage):
    """Nulls in any column, empty and long texts, repeated rows, no rows, and columns with names that are used within."""
    prose = "the weather in the north of the country was cold and the people stayed in their houses for most of the day because of it "
    rows = [(i, prose.replace("north", f"n{i}") * (1 + i % 3), "en" if i % 2 else None, None if i % 3 else "s", None, i, 5, "kept") for i in range(12)]
    rows += [rows[0], rows[0], (None, None, None, None, None, None, None, None), (None, prose, "en", "s", 3, 0, 0, ""), (50, "", "en", "s", 0, 1, 1, "x"), (51, prose * 4000, "en", "t", 9, 1, 1, "x")]
    docs = spark.createDataFrame(rows, EDGES)
    out = stage(spark, docs, SF)
    if stage is not corpus_pipeline.packing_stage:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, docs.limit(0), SF).count() == 0
