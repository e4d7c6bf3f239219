"""From raw documents to packed token sequences: each stage is one corpus operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import jaccard, mixing, packing, pii, toxicity
from gridspark.llm.common import Kept, table
from gridspark.llm.queries import mix_settings


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.3 or more for toxicity; a NULL or empty text has no toxic passage."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates; texts without words and NULL ids stay."""
    return jaccard.one_per_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the text and corrects n_chars; no document goes."""
    masked = docs.withColumn("text", pii.redacted("text", pii.fit(docs)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents so that domains, languages and sources have their weights in four fifths of the tokens, each
    document once at most."""
    return mixing.mix(docs, *mix_settings(docs), share=0.8, epochs=1)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per token piece with its sequence and place in it."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", toxic_documents), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("mixing", mixed_sources), ("packing", packed_sequences),
]

# Log-odds, boosted trees and tokens are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    kept, docs = Kept(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = kept.write(stage(spark, docs, sf_dir))
    return docs
