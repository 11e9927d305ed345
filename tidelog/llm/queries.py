"""The ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chat, divergence, jaccard, language, licenses, middles, mixing, neighbours, packing, quality, repeats, spotsigs, tokens
from tidelog.llm.oracles import ORACLE_SQL
from tidelog.llm.storage import table


def _remainder(n: int) -> Column:
    """Of the id's checksum; a null id counts as the empty text, whose checksum is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=5, num=3, den=4)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3.0)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", mixing.word_count(F.col("text")).alias("size"))
    return packing.pack(sizes)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder(3) == 1
    model = quality.fit_quality_model(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score_quality(docs, model).withColumn("held_out", held_out)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder(4) == 2
    model = language.fit_language_model(docs, ~held_out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_digests(spark))
    return found.select("doc_id", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"), "n_rows")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.probe_edits(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50, top=5)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middles.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, fim_percent=100, spm_percent=50)
    sha256 = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    back = middles.restored(F.col("fim_text"), F.col("form"))
    return cut.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha256(F.col("fim_text")).alias("output_sha256"), sha256(back).alias("restored_sha256"))


#: What a template must keep apart from its own marks.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(*chat.chat_trees(turns.unionByName(hard))).withColumnRenamed("conv", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard, op2_mixing, op3_packing, op4_quality, op5_tokens, op6_language, op7_licenses, op8_spotsigs, op9_neighbours, op10_repeats, op11_divergence, op12_middles, op13_chat)}

__all__ = ["ORACLE_SQL", "QUERIES"]
