"""A training-data pipeline over the documents table: language, toxicity, near-duplicates, packing.

The first three stages return the columns of documents for the rows that stay; the last returns the packed pieces.
Each stage judges all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionflow.llm import jaccard, language, packing, toxicity
from mentionflow.llm.common import materialize, table
from mentionflow.llm.queries import WORD_FILE


#: Phrases a character from which on a text is of no learned language: on average not even its pairs of characters are known.
STRANGE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: a null text, one without a letter, or one that the parse finds strange. Rows are judged one by one, whatever their keys."""
    found = language.identify(docs, language.learn(docs), whole=True)
    return found.filter((F.col("lang_pred") != "und") & (F.coalesce("phrase_rate", F.lit(0.0)) <= STRANGE)).select("own.*")


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity of 0.5 or more."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, whole=True).filter("score < 0.5").select("own.*")


def by_likeness(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the least doc_id."""
    return jaccard.distinct(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 ids."""
    import public_tokenizers

    return packing.op9(docs, public_tokenizers.path(WORD_FILE))


STAGES = [("language", by_language), ("toxicity", by_toxicity), ("near_duplicates", by_likeness), ("packing", packed)]

#: SQL expresses none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
