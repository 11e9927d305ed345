"""A corpus pipeline of five stages: from documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import jaccard, language, mixing, packing, repeats
from tidelog.llm.storage import Scope, table

def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scope: Scope | None = None) -> DataFrame:
    """Documents whose language is known well enough; those without one get it."""
    model = language.fit_language_model(docs, F.lit(True))
    found = language.identify(docs, model).where("NOT rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scope: Scope | None = None) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.drop_near_duplicates(docs, size=5, num=3, den=4, scope=scope)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scope: Scope | None = None) -> DataFrame:
    """Texts without passages that occur earlier; documents of which nothing is left go."""
    kept = repeats.remove_repeats(docs, window=20, scope=scope).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scope: Scope | None = None) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs, weights=(5, 2, 1), most=3.0, scope=scope)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scope: Scope | None = None) -> DataFrame:
    """Bins of words, one row for each piece of a document."""
    return packing.pack(docs.select("doc_id", mixing.word_count(F.col("text")).alias("size")), scope=scope)


#: Each function takes (spark, docs, sf_dir). What it stores on the way stays until the driver ends, or until who gave a scope releases it.
STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substrings", substrings_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Each stage's own files are deleted when its result is written, and that when the next one is."""
    docs, whole = table(spark, sf_dir, "documents"), Scope(spark)
    for name, stage in STAGES[:-1]:
        with Scope(spark) as scope:
            kept = whole.stored(stage(spark, docs, sf_dir, scope), name)
        whole.drop(docs)
        docs = kept
    return packing_stage(spark, docs, sf_dir, whole)


#: Language identification can't be written in SQL.
ORACLE_SQL = None
