"""The corpus pipeline: quality classifier, n-gram Jaccard join, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. An empty table gives an
empty one at every stage; columns besides the id and the text are passed on as
they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import ngram_join, packing, pii, quality
from driftwell.llm.common import materialise, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, doesn't reject.

    A null text is judged as an empty one and stays null. Repeated rows go or stay together; rows without an id are judged
    like others. Without usable labels, or with one class only, nothing is rejected.
    """
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates.

    Texts without words (null, empty) aren't duplicates of each other and stay. Repeated rows of one id become one; a row
    without an id goes if its group has a row with one.
    """
    return ngram_join.keep_one(docs, ngram_join.linked_rows(docs))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars, where there is one, follows the new text.

    Every row stays. A null text stays null, and its n_chars becomes null.
    """
    new = pii.redacted(docs)
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens.

    A null text counts as empty and is one piece of its end token; repeated rows, and rows without an id, each have pieces of their own.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: SQL can't state the classifier's training, so that none is given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
