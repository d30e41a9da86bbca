"""A corpus pipeline: language, toxicity, exact duplicates, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it back as the next stage's input. All stages but the last return the columns of
their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkguard.llm import exact_dedup, language_id, ngram_join, packing, toxicity
from sparkguard.llm.common import discard, materialize, scratch, table
from sparkguard.session import ship


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those predicted `und` (no text, or no letter in it) go.

    Which language it is rejects no document. The model is learned from this stage's input.
    """
    ship(spark)
    plain = docs.drop("lang_pred", "score")
    found = language_id.predict(plain, language_id.train(docs))
    return found.where(F.col("lang_pred") != "und").select(*plain.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. Labels are learned from what the table `labels` holds of the input."""
    ship(spark)
    plain = docs.drop("score", "predicted")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(plain, model).where(F.col("predicted") == 0).select(*plain.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones, the one with the smallest doc_id (null last); rows without words stay."""
    ship(spark)
    return ngram_join.drop_similar(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of at most 4096 tokens."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identified),
    ("toxicity", clean),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_contents),
    ("packing", packed),
]

#: Learned models and tokens have no SQL; the tests hold every stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():  # a stage's own tables and its input go once its output is written
            after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        discard(docs)
        docs = after
    return docs
