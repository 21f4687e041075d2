"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them back as the
next one's documents. All but the last return the columns of ``documents``.

Defined cases, for every stage: extra columns pass through under any name, dots
and the operators' own names included; a null text is an empty one; a row with a
null id is a row like any other; an empty table gives an empty result.
Documents without a letter have no language and go in the second stage. Rows
that repeat an id are judged one by one; near_dedup alone keeps one of those that
agree in id and text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.llm.common import documents, stored
from tierwise.llm.language import drop_unidentified, learn_languages
from tierwise.llm.line_dedup import drop_repeated_lines
from tierwise.llm.minhash import drop_near_duplicates
from tierwise.llm.packing import pack_documents
from tierwise.llm.toxicity import drop_toxic, learn_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic (score 0.5 or more) go."""
    return drop_toxic(docs, learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language accounts for go."""
    return drop_unidentified(docs, learn_languages(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key is in ten documents or more go; every document stays, with what is left of its text."""
    kept = drop_repeated_lines(docs, min_docs=10, keep="none")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.
    Rows are told apart by id and text: of equal rows one stays, and an id's other texts are judged on their own."""
    return drop_near_duplicates(docs, percent=75)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Classifiers, shingle sets and tokens are beyond SQL: tests/llm holds run() against a direct computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
